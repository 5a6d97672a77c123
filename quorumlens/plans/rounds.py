"""More of the catalogue: reconciliation of what is owned, failing reads, hint and handoff rounds, timelines, configurations, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.functions import hashes, scalars
from quorumlens.operators import chaos, config, delivery, membership, placement, reconcile, telemetry
from quorumlens.plans.catalogue import HINTED, ORDER_KEY, PODS, SEVEN, TOPOLOGY, bigint, deduped, fnv, handed, keys, maximal, order_keys, placed, query, replica, replica_sql, ring, table, uncovered, w1
from quorumlens.plans.fixtures import fixture, with_clause
from quorumlens.sources import scratch

# Reconciliation and reads

SHARED = f"{ring('six', PODS)}, k AS (SELECT key, {fnv('key')} AS h FROM (SELECT DISTINCT key FROM W1)), {placed('p', 'k', 'six')}, sh AS (SELECT key FROM p WHERE list_contains(owners, 'kv-0') AND list_contains(owners, 'kv-5'))"


@query(
    f"""{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)}, {SHARED}
SELECT 'pulled' AS direction, key, seq FROM ({uncovered('ra', 'rb')}) WHERE key IN (SELECT key FROM sh) UNION ALL SELECT 'pushed', key, seq FROM ({uncovered('rb', 'ra')}) WHERE key IN (SELECT key FROM sh)"""
)
def reconciled_owned(spark, sf):
    """What kv-0 and kv-5 exchange of the keys that both own."""
    a, b = (scratch.written(replica(spark, sf, skip), "replica") for skip in (7, 5))
    pull, push = reconcile.exchanged(a, b, reconcile.divergent(reconcile.leaves(a), reconcile.leaves(b)), shared=(PODS, 3, "kv-0", "kv-5"))
    told = lambda df, name: df.select(F.lit(name).alias("direction"), "key", "seq")
    return told(pull, "pulled").unionByName(told(push, "pushed"))


@query(
    f"""{with_clause('W1')}, {SHARED} SELECT list_contains(owners, 'kv-0') AS first, list_contains(owners, 'kv-5') AS second, list_contains(owners, 'kv-0') AND list_contains(owners, 'kv-5') AS shared, count(*) AS n FROM p GROUP BY ALL"""
)
def shared_replicas(spark, sf):
    placed_ = placement.owners_of(w1(spark, sf).select("key").distinct(), PODS, 3)
    has = lambda node: F.array_contains("owners", node)
    return placed_.groupBy(has("kv-0").alias("first"), has("kv-5").alias("second"), placement.shares_replica(F.col("owners"), F.lit("kv-0"), F.lit("kv-5")).alias("shared")).agg(F.count("*").alias("n"))


ANSWERS = """an AS (SELECT key, rank, (CAST(substr(key, 6) AS BIGINT) + rank) % 3 <> 0 AND NOT (CAST(substr(key, 6) AS BIGINT) % 5 = 0 AND rank = 2) AS ok FROM (SELECT DISTINCT key FROM W1), range(3) AS r(rank)),
ac AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS good, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS bad FROM an WINDOW w AS (PARTITION BY key ORDER BY rank)),
oc AS (SELECT key, max(good) >= 2 AS ok, CAST(arg_min(good, rank) FILTER (WHERE good >= 2 OR bad > 1) AS BIGINT) AS responses FROM ac GROUP BY key)"""


def answers(spark, sf):
    """Three replicas' answers by key: each third one fails, and the last one for each fifth key."""
    i = F.substr("key", F.lit(6)).cast("long")
    rows = w1(spark, sf).select("key").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.withColumn("ok", ((i + F.col("rank")) % 3 != 0) & ~((i % 5 == 0) & (F.col("rank") == 2)))


@query(f"{with_clause('W1')}, {ANSWERS} SELECT key, ok, responses FROM oc")
def quorum_read_failed(spark, sf):
    return delivery.read_outcomes(answers(spark, sf), 2)


@query(
    f"""{with_clause('W1')}, {ANSWERS}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)}, {replica_sql('rc', 3)},
u AS (SELECT r.* FROM (SELECT 0 AS rank, key, seq, v0, v1, v2 FROM ra UNION ALL SELECT 1, key, seq, v0, v1, v2 FROM rb UNION ALL SELECT 2, key, seq, v0, v1, v2 FROM rc) r
 JOIN ac ON ac.key = r.key AND ac.rank = r.rank AND ac.ok AND ac.good <= 2 JOIN oc ON oc.key = r.key AND oc.ok), {deduped('d', 'u', 'rank, seq')}, {maximal('s', 'd')} SELECT key, seq, CAST(rank AS BIGINT) AS rank FROM s"""
)
def quorum_read_survivors(spark, sf):
    """What reads return that enough replicas answered: the first two good answers merged."""
    held = None
    for rank, skip in enumerate((7, 5, 3)):
        one = replica(spark, sf, skip).withColumn("rank", F.lit(rank))
        held = one if held is None else held.unionByName(one)
    return bigint(delivery.quorum_reads(held, answers(spark, sf), 2)[1].select("key", "seq", "rank"))


@query("SELECT a.node, b.node AS peer, row_number() OVER (PARTITION BY a.node ORDER BY b.node) AS turn FROM (SELECT 'kv-' || i AS node FROM range(7) AS r(i)) a JOIN (SELECT 'kv-' || i AS node FROM range(7) AS r(i)) b ON a.node <> b.node WHERE b.node NOT IN ('kv-2')")
def anti_entropy_turns(spark, sf):
    return bigint(delivery.turns(spark.createDataFrame([(m,) for m in SEVEN], "id string"), ["kv-2"]))


# Hints and handoffs

CODE = "CASE WHEN seq % 97 = 0 AND target = 'kv-1' THEN 'Unavailable' WHEN seq % 31 = 0 THEN 'Internal' END"


@query(
    f"""{with_clause('W1')}, {HINTED}, c AS (SELECT *, {CODE} AS code FROM hh), st AS (SELECT target, min(seq) AS stop FROM c WHERE code = 'Unavailable' GROUP BY target)
SELECT target, CASE WHEN target NOT IN ('kv-0', 'kv-1') THEN 'skipped' WHEN seq > stop THEN 'not tried' WHEN code IS NOT NULL THEN 'kept' ELSE 'delivered' END AS outcome, count(*) AS n FROM c LEFT JOIN st USING (target) GROUP BY ALL"""
)
def hint_delivery_round(spark, sf):
    hints = w1(spark, sf).select("key", "seq", F.col("node").alias("target"))
    code = F.when((F.col("seq") % 97 == 0) & (F.col("target") == "kv-1"), "Unavailable").when(F.col("seq") % 31 == 0, "Internal")
    return delivery.delivered(hints.withColumn("code", code), ["kv-0", "kv-1"]).groupBy("target", "outcome").agg(F.count("*").alias("n"))


@query(f"{with_clause('W1')}, {HINTED} SELECT target, seq % 4 < 2 AS marker, count(*) AS n FROM hh GROUP BY ALL")
def delivery_markers(spark, sf):
    """Clock entries that mark delivered hints, told from ordinary versions."""
    rows = w1(spark, sf).select(F.col("node").alias("target"), F.when(F.col("seq") % 4 < 2, F.map_concat("clock", F.create_map(F.lit(scalars.DELIVERED), F.lit(1).cast("long")))).otherwise(F.col("clock")).alias("clock"))
    return rows.groupBy("target", scalars.is_marker(F.col("clock")).alias("marker")).agg(F.count("*").alias("n"))


def handoff_sql(before: list[str], after: list[str]) -> str:
    names = ", ".join(f"'{m}'" for m in after)
    return f"""{handed(before, after)}, t AS (SELECT key, source, target, CASE WHEN {fnv('key')} % 5 <> 0 THEN 'pushed' WHEN source IN ({names}) THEN 'hinted' ELSE 'retried' END AS outcome FROM h),
bk AS (SELECT source, key, count(*) FILTER (WHERE outcome = 'pushed') AS pushed, count(*) FILTER (WHERE outcome = 'hinted') AS hinted, count(*) FILTER (WHERE outcome = 'retried') AS retried FROM t GROUP BY ALL)
SELECT source, CAST(sum(pushed) AS BIGINT) AS pushed, CAST(sum(hinted) AS BIGINT) AS hinted, count(*) FILTER (WHERE retried > 0) AS pending, count(*) FILTER (WHERE retried > 0) = 0 AS done FROM bk GROUP BY source"""


def handoff_run(spark, sf, before, after):
    pushes = placement.handoff(order_keys(spark, sf), before, after, 3)
    return delivery.handoff_status(delivery.handed_off(pushes, F.col("source").isin(after), hashes.fnv1a32(F.col("key")) % 5 != 0))


@query(handoff_sql(PODS, SEVEN))
def handoff_status_up(spark, sf):
    return handoff_run(spark, sf, PODS, SEVEN)


@query(handoff_sql(SEVEN, PODS))
def handoff_status_down(spark, sf):
    return handoff_run(spark, sf, SEVEN, PODS)


VIEWS = "v AS (SELECT concat('kv-', user_id) AS node, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, event_type = 'purchase' AS completed FROM events)"


@query(f"WITH {VIEWS}, b AS (SELECT *, coalesce(max(CASE WHEN completed THEN epoch END) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, lead(epoch) OVER (PARTITION BY node ORDER BY seq) AS later FROM v) SELECT node, seq, epoch, completed, base, epoch > base AS started, NOT completed AND coalesce(later > epoch, false) AS superseded FROM b")
def handoff_bases(spark, sf):
    views = table(spark, sf, "events").selectExpr("concat('kv-', user_id) as node", "event_id as seq", "cast(row_number() over (partition by user_id order by event_id) as bigint) as epoch", "event_type = 'purchase' as completed")
    return delivery.handoff_bases(views)


# Timelines, rings and configurations

MORE_EVENTS = [("t2", "inject", "down:kv-9", None), ("t3", "inject", "zone:x", None), ("t4", "inject", "partition:kv-0,kv-1,kv-2,kv-3,kv-4,kv-5", None), ("t5", "inject", "zone:b", None), ("t5", "mark", None, "serving-kv-0"), ("t5", "mark", None, "serving-kv-1"), ("t6", "inject", "partition-zone:c", None), ("t6", "mark", None, "serving-kv-1"), ("t7", "inject", "none", None), ("t8", "inject", "odd:kv-1", None), ("t9", "inject", "down:", None)]
MORE_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in MORE_EVENTS)
MEMBER_LIST = ", ".join(f"'{p}'" for p in PODS)


@query(
    f"""{with_clause('T')}, x AS (SELECT test, event, fault, mark FROM T UNION ALL SELECT * FROM (VALUES {MORE_SQL}) AS m(test, event, fault, mark)),
f AS (SELECT test, fault, split_part(fault, ':', 1) AS kind, string_split(split_part(fault, ':', 2), ',') AS pods, split_part(fault, ':', 2) AS rest FROM x WHERE event = 'inject'),
g AS (SELECT *, CASE WHEN fault = 'none' THEN true WHEN kind IN ('down', 'partition') THEN len(list_filter(pods, lambda p: p NOT IN ({MEMBER_LIST}))) = 0 AND (kind = 'down' OR len(list_distinct(pods)) < 6) WHEN kind IN ('zone', 'partition-zone') THEN rest IN ('b', 'c', 'd') ELSE false END AS known,
 CASE WHEN kind = 'down' THEN pods WHEN kind = 'zone' AND rest = 'b' THEN ['kv-0', 'kv-5'] WHEN kind = 'zone' AND rest = 'c' THEN ['kv-1', 'kv-4'] WHEN kind = 'zone' AND rest = 'd' THEN ['kv-2', 'kv-3'] ELSE [] END AS down FROM f),
k AS (SELECT DISTINCT test, substr(mark, 9) AS pod FROM x WHERE event = 'mark' AND mark LIKE 'serving-%')
SELECT test, 'unknown fault' AS error FROM g WHERE NOT known UNION ALL SELECT DISTINCT test, 'a mark of a member that is not down' FROM k JOIN g USING (test) WHERE known AND NOT list_contains(down, pod)"""
)
def timeline_faults(spark, sf):
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(MORE_EVENTS)], "test string, event string, fault string, mark string, time_ns long")
    return chaos.timeline_errors(fixture(spark, sf, "T").unionByName(rows), TOPOLOGY)


MEMBERS = "string_agg('member \"kv-' || i || '\" \"kv-' || i || '.kv.kvstore.svc.cluster.local:7000\"' || chr(10), '' ORDER BY i)"


@query(f"WITH f AS (SELECT k, sha256({MEMBERS} || 'n 3' || chr(10) || 'vnodes 150' || chr(10) || 'scheme ring-v1' || chr(10)) AS fp FROM (SELECT k, unnest(range(k)) AS i FROM range(3, 11) AS r(k)) GROUP BY k) SELECT a.k AS members, a.fp = b.fp AS accepted FROM f a JOIN f b ON b.k = a.k + 1 - a.k % 2 WHERE a.k < 10")
def foreign_ring(spark, sf):
    """Whether a told fingerprint is that of the members: of every second size it is another ring's."""
    sizes = spark.range(3, 10).withColumnRenamed("id", "members")
    of = lambda n: hashes.fingerprint(F.map_from_entries(membership.wanted(F.lit("kv"), F.lit("kvstore"), n)), F.lit(3))
    n = F.col("members").cast("int")
    return sizes.select("members", (of(n) == of(n + 1 - n % 2)).alias("accepted"))


CONFIGS = """c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 31 = 0 THEN '' WHEN s_suppkey % 29 = 0 THEN 'kv#0' WHEN s_suppkey % 23 = 0 THEN 'kv-9' ELSE 'kv-1' END AS node_id,
 CASE WHEN s_suppkey % 19 = 0 THEN '' ELSE '/data' END AS data_dir, s_suppkey % 5 AS w, s_suppkey % 7 AS r, 3 + s_suppkey % 2 AS n, CASE WHEN s_suppkey % 11 = 0 THEN 'kv-0' ELSE 'kv-2' END AS third, CASE WHEN s_suppkey % 13 = 0 THEN 'a0' ELSE 'a2' END AS address,
 s_suppkey % 17 AS shutdown, s_suppkey % 4 AS wait, s_suppkey % 37 AS misses, s_suppkey % 41 AS bytes FROM supplier)"""


@query(
    f"""WITH {CONFIGS} SELECT id, CASE WHEN node_id = '' THEN 'node id missing' WHEN contains(node_id, '#') THEN 'node id with separator' WHEN third = 'kv-0' THEN 'member id twice' WHEN address = 'a0' THEN 'address twice'
 WHEN node_id NOT IN ('kv-0', 'kv-1', third) THEN 'node is no member' WHEN data_dir = '' THEN 'data directory missing' WHEN w < 1 OR w > n THEN 'w out of range' WHEN r < 1 OR r > n THEN 'r out of range' WHEN n > 3 THEN 'n over members'
 WHEN shutdown <= 0 OR wait <= 0 THEN 'duration not positive' WHEN wait >= 3 THEN 'heartbeat timeout not under interval' WHEN misses <= 0 THEN 'missed heartbeats not positive' WHEN bytes <= 0 THEN 'memtable not positive' END AS problem FROM c"""
)
def config_problems(spark, sf):
    i = F.col("s_suppkey")
    member = lambda name, at: F.struct(F.lit(name).alias("id") if isinstance(name, str) else name.alias("id"), F.lit(at).alias("address") if isinstance(at, str) else at.alias("address"))
    rows = table(spark, sf, "supplier").select(
        i.alias("id"), F.when(i % 31 == 0, "").when(i % 29 == 0, "kv#0").when(i % 23 == 0, "kv-9").otherwise("kv-1").alias("node_id"), F.when(i % 19 == 0, "").otherwise("/data").alias("data_dir"),
        (i % 5).alias("w"), (i % 7).alias("r"), (3 + i % 2).alias("n"),
        F.array(member("kv-0", "a0"), member("kv-1", "a1"), member(F.when(i % 11 == 0, "kv-0").otherwise("kv-2"), F.when(i % 13 == 0, "a0").otherwise("a2"))).alias("members"),
        *[F.lit(10).alias(d) for d in ("compaction", "anti_entropy", "hint_delivery", "replication", "max_reconnect_backoff")],
        (i % 17).alias("shutdown"), F.lit(3).alias("heartbeat"), (i % 4).alias("heartbeat_timeout"), (i % 37).alias("max_missed"), (i % 41).alias("memtable_bytes"),
    )
    return config.problems(rows).select("id", "problem")


# Scalars

@query(
    """SELECT s_suppkey AS id, CAST(100 * (s_suppkey % 7) / 7.0 AS DOUBLE) AS share, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '[1,' || s_suppkey || ']' END AS json_text, 3 * 1000000000::BIGINT + 500000000 AS detection_ns, CAST(2 * 1000000000::BIGINT + 500000000 + 5000000000 AS BIGINT) AS recovery_ns,
 CAST(300 AS DOUBLE) AS rates, CAST(10 + s_suppkey % 60 AS BIGINT) AS secs, true AS crc_ok, 'kv-' || s_suppkey % 6 || '.kv.kvstore.svc.cluster.local:7000' AS address, CAST(s_suppkey % 6 AS BIGINT) AS ordinal, printf('%5.1f%%', 100 * (s_suppkey % 7) / 7.0) AS percent,
 CASE WHEN (s_suppkey % 7) BETWEEN 1 AND 3 AND (s_suppkey % 5) BETWEEN 1 AND 3 THEN true ELSE false END AS quorum_ok FROM supplier"""
)
def more_scalars(spark, sf):
    i = F.col("s_suppkey")
    spec = F.concat(F.lit("100:10,200:"), i % 60)
    crc = F.conv(F.hex(F.crc32(F.encode("s_name", "UTF-8"))), 16, 10).cast("long")
    pod = F.concat(F.lit("kv-"), i % 6)
    quoted = F.when(i % 2 == 0, F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))).otherwise(F.concat(F.lit("[1,"), i, F.lit("]")))
    told = scalars.stages(spec)
    return table(spark, sf, "supplier").select(
        i.alias("id"), (100 * (i % 7) / 7.0).cast("double").alias("share"), scalars.json_value(quoted).alias("json_text"), F.lit(scalars.detection_ns(1_000_000_000, 500_000_000, 3)).cast("long").alias("detection_ns"),
        F.lit(scalars.recovery_ns(5_000_000_000, 1_000_000_000, 500_000_000)).cast("long").alias("recovery_ns"),
        F.aggregate(told, F.lit(0.0), lambda a, x: a + x["rate"]).alias("rates"), F.aggregate(told, F.lit(0).cast("long"), lambda a, x: a + x["secs"]).alias("secs"),
        hashes.frame_crc_ok(F.encode("s_name", "UTF-8"), crc).alias("crc_ok"), F.concat(pod, F.lit("." + scalars.member_address("kv-0", "kvstore").split(".", 1)[1])).alias("address"), scalars.ordinal(pod).cast("long").alias("ordinal"),
        scalars.percent((i % 7) / 7.0).alias("percent"), ((i % 7).between(1, 3) & (i % 5).between(1, 3)).alias("quorum_ok"),
    )


@query("SELECT zone, string_agg(pod, ',' ORDER BY pod) AS pods FROM (VALUES ('kv-0','b'),('kv-1','c'),('kv-2','d'),('kv-3','d'),('kv-4','c'),('kv-5','b')) AS v(pod, zone) GROUP BY zone")
def zone_members(spark, sf):
    return spark.createDataFrame([(z, ",".join(p)) for z, p in TOPOLOGY.zone_pods().items()], "zone string, pods string")


@query(f"WITH a AS (SELECT user_id AS id, event_type <> 'error' AS answered, event_id AS seq, epoch_us(ts) AS now FROM events), i AS (SELECT *, sum(CASE WHEN answered THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS island FROM a) SELECT id AS uid, seq, answered, CASE WHEN NOT answered THEN min(CASE WHEN NOT answered THEN now END) OVER (PARTITION BY id, island ORDER BY seq) END AS since FROM i")
def unreachable_since(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id as uid", "event_id as seq", "event_type <> 'error' as answered", "unix_micros(cast(ts as timestamp)) as now")
    return delivery.unreachable_since(rows).select("uid", "seq", "answered", "since")


@query("SELECT a.i AS i, b.i AS j, a.i = b.i AS same FROM range(3, 7) AS a(i), range(3, 7) AS b(i)")
def member_sets_equal(spark, sf):
    told = lambda n: membership.entries(F.map_from_entries(membership.wanted(F.lit("kv"), F.lit("kvstore"), n.cast("int"))))
    a, b = spark.range(3, 7).withColumnRenamed("id", "i"), spark.range(3, 7).withColumnRenamed("id", "j")
    return a.join(F.broadcast(b)).select("i", "j", (told(F.col("i")) == told(F.col("j"))).alias("same"))  # four rows each


# Metrics

DAY = 86_400


@query(
    f"""{with_clause('T', 'MT')}, m AS (SELECT test AS mark, time_ns // 1000 AS at_us FROM T WHERE event = 'inject'), g AS (SELECT mark, o AS offset_s, at_us + o * 1000000 AS t FROM m, range(-60, 31, 15) AS r(o))
SELECT mark, instance, code, CAST(offset_s AS BIGINT) AS offset_s, arg_max(counter_value, (time_us, sample)) AS value FROM g JOIN MT ON time_us <= t AND time_us > t - {DAY}000000 GROUP BY ALL"""
)
def samples_around_marks(spark, sf):
    marks = fixture(spark, sf, "T").filter("event = 'inject'").select(F.col("test").alias("mark"), F.floor(F.col("time_ns") / 1000).cast("long").alias("at_us"))
    return bigint(telemetry.around(fixture(spark, sf, "MT"), marks, ["instance", "code"], lookback_s=DAY))


def shown(metric: str) -> int:
    return sum(ord(c) for c in metric) % 89 + 1


METRIC_ROWS = ", ".join(f"('{m}', '{x}', {shown(m + x)}, {shown(telemetry.ABSENT_UNTIL[m]) if m in telemetry.ABSENT_UNTIL else 0})" for m, all_ in telemetry.NODE_METRICS.items() for x in all_)


@query(
    f"""WITH s AS (SELECT concat('kv-', user_id % 9) AS instance, count(*) AS n FROM events GROUP BY 1), m AS (SELECT * FROM (VALUES {METRIC_ROWS}) AS v(metric, label, k, u))
SELECT instance, metric, label, CAST((n * k) % 1009 AS DOUBLE) AS value FROM s, m WHERE u = 0 OR (n * u) % 3 > 0"""
)
def node_snapshot(spark, sf):
    """Every metric of a node, from made-up numbers; those of what has not happened are absent."""
    stats = table(spark, sf, "events").groupBy(F.concat(F.lit("kv-"), F.col("user_id") % 9).alias("instance")).agg(F.count("*").alias("n"))
    stats = stats.withColumns({c: (F.col("n") * shown(c)) % 3 for c in set(telemetry.ABSENT_UNTIL.values())})
    return telemetry.node_snapshot(stats, lambda m, x: (F.col("n") * shown(m + x)) % 1009)
