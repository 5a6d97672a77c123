"""The rest of the catalogue: views, members, peers, commits of layers, marks, durations, answers of a metrics store."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.functions import hashes, scalars
from quorumlens.operators import chaos, delivery, layers, membership, placement, telemetry, versions
from quorumlens.plans.catalogue import PODS, REQUESTS, TOPOLOGY, bigint, deduped, fnv, maximal, owned_requests, query, replica, replica_sql, requests, ring, table, w1, w2
from quorumlens.plans.fixtures import fixture, with_clause
from quorumlens.sources import logs, scratch, sinks

# Members and views


@query(f"{REQUESTS} SELECT seq, list_contains(owners, 'kv-0') AS is_replica, array_to_string(list_filter(owners, lambda o: o <> 'kv-0'), ',') AS peers FROM p")
def replica_peers(spark, sf):
    peers, own = placement.without_self(F.col("owners"), "kv-0")
    return owned_requests(spark, sf).select("seq", own.alias("is_replica"), F.array_join(peers, ",").alias("peers"))


@query(f"SELECT CAST(k AS BIGINT) AS size, count(DISTINCT pos) AS positions, min(pos) AS lowest, max(pos) AS highest FROM (SELECT k, {fnv('name')} AS pos FROM (SELECT k, 'kv-' || m || '-' || i AS name FROM range(1, 10) AS a(k), range(9) AS b(m), range(150) AS c(i) WHERE m < k)) GROUP BY k")
def initial_views(spark, sf):
    sizes = spark.range(1, 10).select(F.col("id").alias("size"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("id") - 1), lambda i: F.concat(F.lit("kv-"), i)).alias("members"))
    return placement.views(sizes)


MEMBERS = "string_agg('member \"kv-' || i || '\" \"kv-' || i || '.kv.kvstore.svc.cluster.local:7000\"' || chr(10), '' ORDER BY i)"


@query(f"WITH f AS (SELECT k, sha256({MEMBERS} || 'n 3' || chr(10) || 'vnodes 150' || chr(10) || 'scheme ring-v1' || chr(10)) AS fp FROM (SELECT k, unnest(range(k)) AS i FROM range(3, 10) AS r(k)) GROUP BY k) SELECT k AS epoch, CASE WHEN k = 5 THEN NULL ELSE k END AS size, CASE k WHEN 4 THEN 'another ring''s fingerprint' WHEN 5 THEN 'unreadable' END AS problem, CASE WHEN k NOT IN (4, 5) THEN fp END AS fingerprint FROM f")
def membership_files(spark, sf):
    """Views persisted and loaded: one was changed by hand, one is cut short."""
    views = spark.range(3, 10).select(F.col("id").alias("epoch"), F.lit(3).alias("n"), F.map_from_entries(membership.wanted(F.lit("kv"), F.lit("kvstore"), F.col("id").cast("int"))).alias("members"))
    kept = membership.persisted(views).select(F.col("epoch").alias("file"), "text")
    path = scratch.folder(spark, "views")
    hurt = F.when(F.col("file") == 4, F.replace("text", F.lit("kv-1.kv"), F.lit("kv-1.other"))).when(F.col("file") == 5, F.substring("text", 1, 40)).otherwise(F.col("text"))
    kept.withColumn("text", hurt).write.parquet(path)
    back = membership.loaded(spark.read.parquet(path))
    good = F.col("problem").isNull()
    return back.select(F.col("file").alias("epoch"), F.when(F.col("file") != 5, F.size("members").cast("long")).alias("size"), "problem", F.when(good, F.col("fingerprint")).alias("fingerprint"))


@query(
    """WITH p AS (SELECT concat('kv-', user_id % 4) AS observer, concat('kv-', user_id % 7 + 4) AS peer, event_id AS seq, event_type IN ('view', 'click') AND user_id % 5 <> 0 AS ok FROM events),
l AS (SELECT observer, peer, max(seq) FILTER (WHERE ok) AS good FROM p GROUP BY ALL), m AS (SELECT p.observer, p.peer, count(*) FILTER (WHERE good IS NULL OR seq > good) AS missed FROM p JOIN l ON p.observer = l.observer AND p.peer = l.peer GROUP BY ALL)
SELECT observer, peer, missed, missed = 0 AS reachable, missed < 3 AS alive FROM m"""
)
def peer_states(spark, sf):
    pings = table(spark, sf, "events").selectExpr("concat('kv-', user_id % 4) as observer", "concat('kv-', user_id % 7 + 4) as peer", "event_id as seq", "event_type in ('view', 'click') and user_id % 5 <> 0 as ok")
    return membership.peer_states(pings)


@query("SELECT * FROM (VALUES ('odd member kv#1'), ('odd member '), ('address used twice: a:1'), ('fewer than 6 members')) AS v(problem)")
def member_problems(spark, sf):
    told = [("kv-0", "a:1"), ("kv#1", "a:2"), ("kv-2", "a:1"), ("", "a:3"), ("kv-4", "a:4")]
    return logs.members_problems(spark.createDataFrame(told, "id string, address string"), 6)


@query("SELECT s_suppkey AS id, 'kv-' || s_suppkey % 5 AS pod, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'zone-' || s_suppkey % 2 END AS zone, CASE WHEN s_suppkey % 5 = 4 THEN 'no zone' WHEN s_suppkey % 5 = 3 THEN 'not a member' WHEN s_suppkey % 5 = 2 THEN 'no membership' ELSE 'memberships differ' END AS error FROM supplier")
def placed_pods(spark, sf):
    """Pods joined with nodes' zones, members and the views they hold; whatever is missing, or held differently, is told."""
    i = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    pods = s.select(F.concat(F.lit("pod-"), i).alias("id"), F.when(i % 5 != 4, F.concat(F.lit("node-"), i % 2)).otherwise("gone").alias("node"))
    nodes = spark.createDataFrame([("node-0", "zone-0"), ("node-1", "zone-1")], "node string, zone string")
    members = s.filter(i % 5 != 3).select(F.concat(F.lit("pod-"), i).alias("id"), F.concat(F.lit("a:"), i).alias("address"))
    views = s.filter(i % 5 != 2).select(F.concat(F.lit("pod-"), i).alias("id"), (i % 3).cast("long").alias("epoch"), F.lit("f").alias("fingerprint"))
    number = F.substr("id", F.lit(5)).cast("long")
    return logs.placed_pods(pods, nodes, members, views).select(number.alias("id"), F.concat(F.lit("kv-"), number % 5).alias("pod"), "zone", "error")


@query(f"{with_clause('W1')}, {replica_sql('ra', 7)}, k AS (SELECT 'user-' || i AS key FROM range(0, 400, 7) AS r(i)) SELECT k.key, count(seq) > 0 AS found, count(seq) AS n FROM k LEFT JOIN ra ON ra.key = k.key GROUP BY k.key")
def local_fetch(spark, sf):
    """What one replica alone answers for a list of keys: none found is an answer, not an error."""
    asked = spark.range(0, 400, 7).select(F.concat(F.lit("user-"), "id").alias("key"))
    held = asked.join(replica(spark, sf, 7), "key", "left").groupBy("key").agg(F.count("seq").alias("n"))
    return held.select("key", (F.col("n") > 0).alias("found"), "n")


# Commits


@query(f"{with_clause('W2')}, {deduped('d', 'W2')}, {maximal('s', 'd')} SELECT key, count(*) AS n, max(seq) AS last FROM s GROUP BY key")
def compaction_commit(spark, sf):
    """Layers in files; a run of them is merged, registered and the sources retired in one commit: what is visible stays."""
    base = scratch.folder(spark, "store")
    rows = w2(spark, sf)
    named = {rank: f"sst_{9 - rank:03d}" for rank in range(6)}
    for rank, name in named.items():
        sinks.write_layer(rows.filter(F.col("layer_rank") == rank), f"{base}/{name}")
    sinks.register(spark, f"{base}/manifest", list(named.values()), [])
    merged = layers.compacted(rows, 1, 4)
    output = layers.compacted_id(named[1])
    sinks.write_layer(merged.drop("layer_rank"), f"{base}/{output}")
    sinks.register(spark, f"{base}/manifest", [output], [named[r] for r in range(1, 5)])
    live = layers.ranked_files(layers.live_files(spark.read.parquet(f"{base}/manifest")), first=0)
    held = None
    for r in live.orderBy("layer_rank").collect():  # a row for each file
        one = spark.read.parquet(f"{base}/{r.id}").drop("layer_rank").withColumn("layer_rank", F.lit(r.layer_rank))
        held = one if held is None else held.unionByName(one)
    return layers.visible(held).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) AS n, max(seq) AS last FROM s GROUP BY key")
def flush_commit(spark, sf):
    """Log segments replayed, flushed to a layer, registered, and dropped: the layer alone shows the state."""
    base = scratch.folder(spark, "store")
    rows = w1(spark, sf).withColumn("segment", hashes.bucket_for(F.col("key"), 4) + 1)
    entry = F.to_json(F.struct(F.col("key").alias("Key"), F.col("seq").cast("string").alias("Value"), F.col("clock").alias("VectorClock"), F.col("node").alias("LastUpdatedBy"), F.col("is_deleted").alias("IsDeleted")))
    sinks.append_log(rows.select("segment", "seq", entry.alias("json")), f"{base}/log").write.format("noop").mode("overwrite").save()
    log = scratch.written(logs.log_versions(logs.log_entries(logs.log_segments(spark, f"{base}/log"))), "log-versions")  # a replay reads it several times
    sinks.write_layer(versions.replay(log).select("key", F.col("value_json").cast("long").alias("seq"), "clock", "is_deleted"), f"{base}/sst_001")
    sinks.register(spark, f"{base}/manifest", ["sst_001"], [])
    sinks.drop_segments(spark, f"{base}/log", 4)
    (one,) = layers.live_files(spark.read.parquet(f"{base}/manifest")).collect()
    return versions.survivors(spark.read.parquet(f"{base}/{one.id}")).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


# Read-backs and timelines


@query(f"{with_clause('Q1', 'RBK')}, acks AS (SELECT DISTINCT key FROM Q1 WHERE op = 'put' AND result = 'ok'), last AS (SELECT key, arg_max(n_owners, time_ns) AS n_owners, arg_max(n_holders, time_ns) AS n_holders FROM RBK GROUP BY key) SELECT key, CAST(n_owners AS BIGINT) AS n_owners, CAST(n_holders AS BIGINT) AS n_holders FROM acks JOIN last USING (key) WHERE n_owners > 0 AND n_holders < n_owners ORDER BY key LIMIT 50")
def under_replicated_keys(spark, sf):
    return bigint(chaos.short_of_copies(requests(spark, sf), fixture(spark, sf, "RBK")))


@query("SELECT concat('t', user_id % 3) AS test, concat('mark-', event_id) AS mark, row_number() OVER (PARTITION BY user_id % 3 ORDER BY floor(value / 10), event_id) AS number FROM events WHERE event_type = 'signup'")
def ordered_marks(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'signup'").select(F.concat(F.lit("t"), F.col("user_id") % 3).alias("test"), F.lit("mark").alias("event"), F.concat(F.lit("mark-"), "event_id").alias("mark"), F.floor(F.col("value") / 10).alias("time_ns"), F.col("event_id").alias("place"))
    return bigint(chaos.ordered_marks(rows))


# Durations and metrics

DURATIONS = [(0, "0s"), (7, "7ns"), (1_500, "1.5µs"), (250_000_000, "250ms"), (1_500_000_000, "1.5s"), (60_000_000_000, "1m0s"), (900_000_000_000, "15m0s"), (3_723_500_000_000, "1h2m3.5s"), (7_200_000_000_000, "2h0m0s"), (-90_000_000_000, "-1m30s")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, '{t}', {n}::BIGINT)" for n, t in DURATIONS) + ") AS v(ns, text, parsed)")
def duration_texts(spark, sf):
    rows = spark.createDataFrame([(n,) for n, _ in DURATIONS], "ns long").withColumn("text", scalars.duration_text(F.col("ns")))
    return rows.withColumn("parsed", scalars.duration_ns(F.col("text")))


@query("SELECT concat('kv-', user_id % 3) AS instance, CAST(epoch_us(ts) AS BIGINT) AS time_us, CAST(event_id % 11 AS DOUBLE) AS value FROM events WHERE event_id % 50 = 0")
def metric_answers(spark, sf):
    """Samples as the answers of a metrics store to range queries, a document for each series, and back."""
    rows = table(spark, sf, "events").filter("event_id % 50 = 0").select(F.concat(F.lit("kv-"), F.col("user_id") % 3).alias("instance"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 11).cast("string").alias("v"))
    point = F.array((F.col("us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string"), "v")
    series = rows.groupBy("instance").agg(F.collect_list(point).alias("values")).select(F.struct(F.create_map(F.lit("instance"), "instance").alias("metric"), "values").alias("s"))
    text = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array("s").alias("result")).alias("data")))
    return logs.prometheus(series.select(text.alias("text"))).select(F.col("metric")["instance"].alias("instance"), "time_us", "value")


@query(f"{with_clause('MT')}, g AS (SELECT instance, code, max(counter_value) AS most FROM MT GROUP BY ALL) SELECT code, max(most) AS most FROM g GROUP BY code")
def largest_gauge(spark, sf):
    """The largest value of any instance's largest over the window."""
    each = fixture(spark, sf, "MT").groupBy("instance", "code").agg(F.max("counter_value").alias("most"))
    return each.groupBy("code").agg(F.max("most").alias("most"))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("SELECT method, code, le, count(*) FILTER (WHERE value <= le) AS n FROM (SELECT CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'Put' ELSE 'Get' END AS method, CASE WHEN event_type = 'error' THEN 'Unavailable' ELSE 'OK' END AS code, value FROM events), (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in BOUNDS) + ", ('infinity'::DOUBLE)) AS b(le) GROUP BY ALL")
def request_durations(spark, sf):
    """Request durations by method and code, in cumulative buckets."""
    rows = table(spark, sf, "events").select(F.when(F.col("event_type").isin("purchase", "signup", "error"), "Put").otherwise("Get").alias("method"), F.when(F.col("event_type") == "error", "Unavailable").otherwise("OK").alias("code"), "value")
    return telemetry.histogram(rows, BOUNDS, by=["method", "code"])


@query("SELECT engine, le, count(*) FILTER (WHERE value <= le) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'hints' ELSE 'data' END AS engine, value FROM events), (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in BOUNDS) + ", ('infinity'::DOUBLE)) AS b(le) GROUP BY ALL")
def storage_durations(spark, sf):
    """What a storage observer sees, by engine, in cumulative buckets."""
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 4 == 0, "hints").otherwise("data").alias("engine"), "value")
    return telemetry.histogram(rows, BOUNDS, by=["engine"])


@query("SELECT user_id % 4 AS writers, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / count(*) FILTER (WHERE event_id % 7 = 0), 6) AS writes_per_sync FROM events GROUP BY 1")
def bench_report(spark, sf):
    """What a storage benchmark reports: latency quantiles of all samples, and writes for each sync."""
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("writers"))
    return e.agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.round(telemetry.ratio(F.count("*"), F.count_if(F.col("event_id") % 7 == 0)), 6).alias("writes_per_sync"))


# Failures and streams


@query("WITH w AS (SELECT concat('kv-', user_id % 6) AS engine, event_id AS seq, event_type = 'error' AND event_id % 97 = 0 AS failed FROM events), f AS (SELECT engine, min(seq) AS first FROM w WHERE failed GROUP BY engine) SELECT engine, CASE WHEN seq > first THEN 'halted' WHEN seq = first THEN 'failed' ELSE 'durable' END AS outcome, count(*) AS n FROM w LEFT JOIN f USING (engine) GROUP BY ALL")
def halted_writes(spark, sf):
    writes = table(spark, sf, "events").selectExpr("concat('kv-', user_id % 6) as engine", "event_id as seq", "event_type = 'error' and event_id % 97 = 0 as failed")
    return delivery.latched(writes, F.col("failed")).groupBy("engine", "outcome").agg(F.count("*").alias("n"))


CODES = "CASE WHEN event_id % 53 = 0 THEN 'Unavailable' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Internal' END"


@query(f"WITH i AS (SELECT user_id AS batch, event_id AS seq, {CODES} AS code FROM events), e AS (SELECT batch, min(seq) FILTER (WHERE code IS NOT NULL) AS stop, arg_min(code, seq) FILTER (WHERE code IS NOT NULL) AS answer FROM i GROUP BY batch) SELECT batch, answer, count(*) FILTER (WHERE stop IS NULL OR seq < stop) AS stored FROM i JOIN e USING (batch) GROUP BY ALL")
def replicated_batches(spark, sf):
    return delivery.replicated(table(spark, sf, "events").selectExpr("user_id as batch", "event_id as seq", f"{CODES} as code"))


FORWARD = "CASE (seq + CAST(substr(o, 4) AS BIGINT)) % 5 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'FailedPrecondition' WHEN 2 THEN 'Internal' END"


@query(
    f"""{REQUESTS}, t AS (SELECT seq, owners, list_filter(owners, lambda o: coalesce({FORWARD}, 'ok') NOT IN ('Unavailable', 'FailedPrecondition'))[1] AS owner FROM p WHERE op = 'put' AND NOT list_contains(owners, target))
SELECT seq, owner, CASE WHEN owner IS NULL THEN 'Unavailable' WHEN (seq + CAST(substr(owner, 4) AS BIGINT)) % 5 = 2 THEN 'Internal' END AS code, CAST(CASE WHEN owner IS NULL THEN len(owners) ELSE list_position(owners, owner) END AS BIGINT) AS tried FROM t"""
)
def forward_failover(spark, sf):
    rows = owned_requests(spark, sf).filter((F.col("op") == "put") & ~F.array_contains("owners", F.col("target")))
    k = lambda o: (F.col("seq") + F.substr(o, F.lit(4)).cast("long")) % 5
    owner, code, tried = delivery.forwarded(F.col("owners"), lambda o: F.when(k(o) == 0, "Unavailable").when(k(o) == 1, "FailedPrecondition").when(k(o) == 2, "Internal"))
    return rows.select("seq", owner.alias("owner"), code.alias("code"), tried.cast("long").alias("tried"))


@query("WITH p AS (SELECT concat('kv-', user_id % 4) AS observer, concat('kv-', user_id % 7 + 4) AS peer, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'in' ELSE 'out' END AS kind, event_type <> 'error' AS ok FROM events), l AS (SELECT *, last_value(CASE WHEN kind = 'out' THEN ok END IGNORE NULLS) OVER (PARTITION BY observer, peer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p) SELECT observer, peer, count(*) AS n FROM l WHERE kind = 'in' AND NOT coalesce(last, true) GROUP BY ALL")
def ping_backs(spark, sf):
    pings = table(spark, sf, "events").selectExpr("concat('kv-', user_id % 4) as observer", "concat('kv-', user_id % 7 + 4) as peer", "event_id as seq", "case when event_id % 3 = 0 then 'in' else 'out' end as kind", "event_type <> 'error' as ok")
    return delivery.ping_backs(pings).groupBy("observer", "peer").agg(F.count("*").alias("n"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) AS n, max(seq) AS last FROM s GROUP BY key")
def late_versions(spark, sf):
    """Versions that arrive late, after the rest was resolved: merged, they leave what they would have left in time."""
    log = w1(spark, sf)
    held = scratch.written(versions.survivors(log.filter("seq % 3 <> 0")), "held")
    return versions.survivors(held.unionByName(log.filter("seq % 3 = 0"))).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(
    f"""{with_clause('STAGES')}, b AS (SELECT *, CAST(coalesce(lag(rate) OVER (ORDER BY place), 50) AS DOUBLE) AS before FROM STAGES), s AS (SELECT *, unnest(range(CAST(move + hold AS BIGINT))) AS second FROM b),
u AS (SELECT place, second, e, floor(before * least(t, move)::DOUBLE + (rate - before) * least(t, move)::DOUBLE * least(t, move)::DOUBLE / (2 * move) + rate * greatest(t - move, 0)::DOUBLE) AS cum FROM (SELECT *, second + e AS t FROM s, (VALUES (0), (1)) AS v(e)))
SELECT CAST(place AS BIGINT) AS place, second, CAST(sum(CASE WHEN e = 1 THEN cum ELSE -cum END) AS BIGINT) AS arrivals FROM u GROUP BY place, second"""
)
def arrival_plan(spark, sf):
    return bigint(telemetry.arrivals(fixture(spark, sf, "STAGES"), 50.0))


@query("WITH r AS (SELECT s_suppkey % 9 AS dropped, s_suppkey % 5 AS errors, s_suppkey AS connects, CAST(s_suppkey % 23 AS DOUBLE) / 4 AS cpu FROM supplier WHERE s_suppkey <= 42) SELECT CAST(sum(dropped) AS BIGINT) AS dropped, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(connects) AS BIGINT) AS connects, max(cpu) AS cpu_max, list_sort(list(cpu))[(len(list(cpu)) + 1) // 2] AS cpu_median FROM r")
def run_totals(spark, sf):
    """Load generators' totals; a run has a few of them."""
    i = F.col("s_suppkey")
    runs = table(spark, sf, "supplier").filter(i <= 42).select((i % 9).alias("dropped"), (i % 5).alias("errors"), i.alias("connects"), ((i % 23).cast("double") / 4).alias("cpu"))
    return bigint(telemetry.run_totals(runs))


@query(
    """WITH RECURSIVE w AS (SELECT concat('kv-', user_id % 6) AS engine, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) AS place, CAST(40 + floor(value) AS BIGINT) AS bytes FROM events),
b AS (SELECT engine, place, bytes, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, bytes AS total FROM w WHERE place = 1
 UNION ALL SELECT w.engine, w.place, w.bytes, CASE WHEN n = 20 OR total + w.bytes > 2000 THEN batch + 1 ELSE batch END, CASE WHEN n = 20 OR total + w.bytes > 2000 THEN 1 ELSE n + 1 END, CASE WHEN n = 20 OR total + w.bytes > 2000 THEN w.bytes ELSE total + w.bytes END
 FROM b JOIN w ON w.engine = b.engine AND w.place = b.place + 1)
SELECT engine, batch, max(n) AS records, max(total) AS bytes FROM b GROUP BY engine, batch"""
)
def group_commits(spark, sf):
    writes = table(spark, sf, "events").selectExpr("concat('kv-', user_id % 6) as engine", "event_id as seq", "cast(40 + floor(value) as bigint) as bytes")
    return delivery.group_commits(writes, max_records=20, max_bytes=2000)


# Reads of one place, rings that grow, quorums that can't be


@query(f"{with_clause('W2')}, {deduped('d', 'W2', where='layer_rank = 0')}, {maximal('s', 'd')} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1 AS ord FROM s WHERE key IN ('part-3', 'part-33', 'part-133', 'none')")
def memtable_read(spark, sf):
    """A point read of the newest layer alone, which is a copy: siblings newest first."""
    rows = w2(spark, sf).filter(F.col("key").isin("part-3", "part-33", "part-133", "none") & (F.col("layer_rank") == 0))
    return bigint(versions.newest_first(versions.survivors(rows)).select("key", "seq", "ord"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, seq, is_deleted, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS ord FROM s WHERE CAST(substr(key, 6) AS BIGINT) % 10 = 3")
def store_read(spark, sf):
    """Reads of a store for a set of keys: all siblings, tombstones too, oldest first."""
    rows = versions.survivors(w1(spark, sf).filter(F.substr("key", F.lit(6)).cast("long") % 10 == 3))
    return bigint(versions.oldest_first(rows).select("key", "seq", "is_deleted", "ord"))


@query(f"WITH {ring('six', PODS)} SELECT pos, m AS node FROM six_r")
def ring_joined(spark, sf):
    """The ring after the sixth member joins five."""
    return spark.createDataFrame(placement.with_member(placement.ring(PODS[:5]), PODS[5]), "pos long, node string")


@query("SELECT n, w, r, w BETWEEN 1 AND n AND r BETWEEN 1 AND n AND n <= 6 AS valid FROM range(1, 9) AS a(n), range(0, 9) AS b(w), range(0, 9) AS c(r)")
def topology_quorums(spark, sf):
    def valid(n: int, w: int, r: int) -> bool:
        try:
            chaos.Topology(TOPOLOGY.zones, n, w, r)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, w, r, valid(n, w, r)) for n in range(1, 9) for w in range(9) for r in range(9)], "n long, w long, r long, valid boolean")
