"""More of the catalogue: writes, folds, sources, scalar expressions, timelines, load tables, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions import clocks, hashes, scalars
from quorumlens.operators import chaos, layers, membership, placement, reconcile, telemetry, versions
from quorumlens.plans.catalogue import HINTED, JUDGED, LINES, PODS, REQUESTS, bigint, fnv, judged, keys, lines, maximal, owned_requests, placed, query, requests, ring, table, w1, w2
from quorumlens.plans.fixtures import fixture, with_clause
from quorumlens.sources import logs

# Writes and folds


@query(
    f"""{with_clause('W1')}, {maximal('s', 'W1')}, c AS (SELECT key, max(v0) AS v0, max(v1) AS v1, max(v2) AS v2 FROM s GROUP BY key),
w AS (SELECT key, max(seq) AS seq, arg_max(is_deleted, seq) AS is_deleted, max(seq) % 3 = 0 AS blind FROM W1 GROUP BY key)
SELECT key, CASE WHEN blind THEN 0 ELSE v0 END AS v0, CASE WHEN blind THEN 1 ELSE v1 + 1 END AS v1, CASE WHEN blind THEN 0 ELSE v2 END AS v2, is_deleted FROM w JOIN c USING (key)"""
)
def versioned_put(spark, sf):
    log = w1(spark, sf).withColumn("value_json", F.col("seq").cast("string"))
    last = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("is_deleted", "seq").alias("is_deleted"))
    blind = F.when(F.col("seq") % 3 == 0, F.expr("cast(map() as map<string,bigint>)"))
    writes = last.select("key", F.col("seq").cast("string").alias("value_json"), blind.alias("context"), F.lit("kv-1").alias("node"), "is_deleted")
    out = versions.put(versions.survivors(log), writes)
    return out.select("key", *[F.coalesce(F.col("clock")[f"kv-{i}"], F.lit(0)).alias(f"v{i}") for i in range(3)], "is_deleted")


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM s GROUP BY key")
def sibling_fold(spark, sf):
    """The fold over all versions of each key."""
    left = versions.folded(w1(spark, sf).select("key", "seq", "clock"))
    seqs = F.array_sort(F.collect_list("seq"))
    return left.groupBy("key").agg(F.count("*").alias("n"), F.array_join(seqs, ",").alias("seqs"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1 AS ord FROM s")
def siblings_newest_first(spark, sf):
    return bigint(versions.newest_first(versions.survivors(w1(spark, sf))).select("key", "seq", "ord"))


@query(f"{with_clause('W2')} SELECT DISTINCT key FROM W2 WHERE layer_rank = 0")
def keys_of_one_layer(spark, sf):
    return layers.keys_of(w2(spark, sf).filter("layer_rank = 0"))


@query(f"{with_clause('W1')}, {HINTED} SELECT DISTINCT target FROM hh")
def hint_targets(spark, sf):
    packed = w1(spark, sf).select(scalars.hint_key(F.col("node"), F.col("key")).alias("packed"))
    return packed.select(scalars.hint_target(F.col("packed")).alias("target")).distinct()


# Sources and scalars


@query("SELECT 'chaos-pre-' || lpad(CAST(i AS VARCHAR), 7, '0') AS key FROM range(5000) AS r(i)")
def key_spec(spark, sf):
    return logs.keys(spark, "chaos-pre:5000")


@query(
    f"""SELECT s_suppkey AS id, concat('kv-', s_suppkey % 6, '#', lpad(CAST(s_suppkey AS VARCHAR), 16, '0')) AS writer, s_name || '|' || repeat('x', greatest(0, 24 - length(s_name) - 1)) AS padded,
 CASE WHEN s_suppkey % 3 = 0 THEN 1500000000 WHEN s_suppkey % 3 = 1 THEN 900000000000 ELSE 500000000 END AS duration_ns, CASE WHEN s_suppkey % 2 = 0 THEN 250.0::DOUBLE ELSE 3000.0::DOUBLE END AS millicores,
 CAST((s_suppkey - 1) // 2 AS BIGINT) AS parent, s_suppkey IN (1, 4, 16, 64) AS power_of_four, CASE s_suppkey % 3 WHEN 0 THEN 'notfound' WHEN 1 THEN 'ok' ELSE 'mismatch' END AS got,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Canceled' ELSE 'Unavailable' END AS client_code, {fnv('s_name')} AS hash FROM supplier"""
)
def scalar_functions(spark, sf):
    i = F.col("s_suppkey")
    spec = F.when(i % 3 == 0, "1.5s").when(i % 3 == 1, "15m0s").otherwise("500ms")
    values = F.when(i % 3 == 1, F.array(F.lit("other"), F.concat("s_name", F.lit("|x")))).otherwise(F.array(F.concat(F.lit("x"), "s_name")))
    return table(spark, sf, "supplier").select(
        i.alias("id"), clocks.writer_id(F.concat(F.lit("kv-"), i % 6), F.lpad(i.cast("string"), 16, "0")).alias("writer"), scalars.synthetic_value(F.col("s_name"), 24).alias("padded"),
        scalars.duration_ns(spec).alias("duration_ns"), scalars.millicores(F.when(i % 2 == 0, "250m").otherwise("3")).alias("millicores"), hashes.parent(i).cast("long").alias("parent"),
        hashes.valid_bucket_count(i).alias("power_of_four"), scalars.classify_get(i % 3 != 0, values, F.col("s_name")).alias("got"),
        scalars.client_code(F.when(i % 2 == 0, "Canceled").otherwise("Internal")).alias("client_code"), hashes.fnv1a32(F.col("s_name")).alias("hash"),
    )


MEMBERS = "string_agg('member \"kv-' || i || '\" \"kv-' || i || '.kv.kvstore.svc.cluster.local:7000\"' || chr(10), '' ORDER BY i)"


@query(f"SELECT k AS members, sha256({MEMBERS} || 'n 3' || chr(10) || 'vnodes 150' || chr(10) || 'scheme ring-v1' || chr(10)) AS fingerprint FROM (SELECT k, unnest(range(k)) AS i FROM range(3, 10) AS r(k)) GROUP BY k")
def membership_fingerprint(spark, sf):
    sizes = spark.range(3, 10).withColumnRenamed("id", "members")
    told = F.map_from_entries(membership.wanted(F.lit("kv"), F.lit("kvstore"), F.col("members").cast("int")))
    return sizes.select("members", hashes.fingerprint(told, F.lit(3)).alias("fingerprint"))


# Chaos


@query(f"{REQUESTS} SELECT op, result, count(*) AS n FROM p GROUP BY ALL")
def op_result_counts(spark, sf):
    return owned_requests(spark, sf).groupBy("op", "result").agg(F.count("*").alias("n"))


@query(f"{with_clause('T')}, {LINES.split('ph AS')[0].rstrip().rstrip(',')} SELECT test, in_from, in_to, out_from, out_to, back FROM wins")
def timeline_windows(spark, sf):
    rows = lines(spark, sf)
    return rows.select("test", "in_from", "in_to", "out_from", "out_to", F.get("backs", F.lit(0))["at"].alias("back"))


@query(f"{with_clause('T')}, b AS (SELECT test, count(*) FILTER (WHERE event = 'inject') AS i, count(*) FILTER (WHERE event = 'heal') AS h FROM (SELECT * FROM T UNION ALL SELECT * FROM T WHERE test = 't1' UNION ALL SELECT 't9', event, fault, mark, time_ns FROM T WHERE test = 't1' AND event = 'heal') GROUP BY test) SELECT test, 'injected twice' AS error FROM b WHERE i > 1 UNION ALL SELECT test, 'healed twice' FROM b WHERE h > 1 UNION ALL SELECT test, 'never injected' FROM b WHERE i = 0")
def timeline_errors(spark, sf):
    t = fixture(spark, sf, "T")
    again = t.filter("test = 't1'")
    stray = again.filter("event = 'heal'").withColumn("test", F.lit("t9"))
    return chaos.timeline_errors(t.unionByName(again).unionByName(stray))


@query(f"{with_clause('Q1')} SELECT key, min(seq) AS first_seq FROM Q1 WHERE op = 'put' GROUP BY key")
def first_put_order(spark, sf):
    return requests(spark, sf).filter("op = 'put'").groupBy("key").agg(F.min("seq").alias("first_seq"))


@query(f"{with_clause('Q1', 'RBK')}, acks AS (SELECT DISTINCT key FROM Q1 WHERE op = 'put' AND result = 'ok'), last AS (SELECT key, arg_max(result, time_ns) AS result FROM RBK GROUP BY key) SELECT key FROM acks JOIN last USING (key) WHERE result IN ('notfound', 'mismatch') ORDER BY key LIMIT 50")
def lost_keys(spark, sf):
    return chaos.listed(requests(spark, sf), fixture(spark, sf, "RBK"))


@query(f"{JUDGED} SELECT expect, CAST(unr AS BIGINT) AS n_unreachable, count(*) AS n FROM j GROUP BY ALL")
def expected_outcomes(spark, sf):
    return judged(spark, sf).groupBy("expect", F.col("n_unreachable").cast("long").alias("n_unreachable")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {ring('six', PODS)}, {keys('k', 'customer', 'c_name', 'c_custkey')}, {placed('p', 'k', 'six')}, o AS (SELECT key, c_custkey, generate_subscripts(owners, 1) AS place, unnest(owners) AS pod FROM p)
SELECT key, count(*) AS n_owners, coalesce(string_agg(pod, ',' ORDER BY place) FILTER (WHERE c_custkey % (place + 4) <> 0), '') AS holders FROM o GROUP BY key"""
)
def copies_per_key(spark, sf):
    owners = placement.owners_of(table(spark, sf, "customer").select(F.col("c_name").alias("key"), "c_custkey"), PODS, 3)
    held = owners.select("key", "c_custkey", F.posexplode("owners").alias("place", "replica")).filter("c_custkey % (place + 5) <> 0")
    found = reconcile.copies(owners.select("key", "owners"), held)
    return found.select("key", "n_owners", F.array_join("holders", ",").alias("holders"))


# Load and telemetry

RAMP = "SELECT * FROM (VALUES (1, 100.0::DOUBLE, 10), (2, 100.0, 60), (3, 200.0, 10), (4, 200.0, 60), (5, 300.0, 5), (6, 300.0, 30)) AS t(place, rate, secs)"


def ramp(spark) -> DataFrame:
    return spark.createDataFrame([(1, 100.0, 10), (2, 100.0, 60), (3, 200.0, 10), (4, 200.0, 60), (5, 300.0, 5), (6, 300.0, 30)], "place int, rate double, secs int")


@query(f"WITH s AS ({RAMP}), w AS (SELECT *, coalesce(lag(rate) OVER (ORDER BY place), 50) AS before, coalesce(sum(secs) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_s FROM s) SELECT row_number() OVER (ORDER BY place) AS step, rate AS target_rate, CAST(from_s AS BIGINT) AS from_s, CAST(from_s + secs AS BIGINT) AS to_s FROM w WHERE rate = before")
def ramp_steps(spark, sf):
    return bigint(telemetry.ramp_steps(ramp(spark), 50.0))


LOAD = [(0, 1, "put", 50.0, 60, 3000, 50.0, 10.5, 0, 0, 0.0), (1, 1, "put", 50.0, 60, 2990, 49.8, 11.0, 0, 10, 1.5), (0, 2, "put", 100.0, 60, 6000, 100.0, 13.0, 0, 0, 61.0), (1, 2, "put", 100.0, 60, 6000, 100.0, 30.5, 0, 0, 61.25), (0, 3, "put", 150.0, 60, 9000, 150.0, 40.0, 4, 0, 121.0)]
LOAD_COLUMNS = "pod int, step int, op string, target_rate double, seconds int, count long, achieved_rate double, p99_ms double, errors long, dropped long, start_s double"
LOAD_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({p}, {s}, '{o}', {t}::DOUBLE, {sec}, {n}, {a}::DOUBLE, {q}::DOUBLE, {e}, {d}, {b}::DOUBLE)" for p, s, o, t, sec, n, a, q, e, d, b in LOAD) + ") AS t(pod, step, op, target_rate, seconds, count, achieved_rate, p99_ms, errors, dropped, start_s)"


def load(spark) -> DataFrame:
    return spark.createDataFrame(LOAD, LOAD_COLUMNS)


@query(f"WITH l AS ({LOAD_SQL}) SELECT CAST(step AS BIGINT) AS step, op, sum(target_rate) AS target_rate, sum(achieved_rate) AS achieved_rate, CAST(sum(count) AS BIGINT) AS count, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(dropped) AS BIGINT) AS dropped, max(p99_ms) AS worst_p99_ms FROM l GROUP BY step, op")
def combined_pods(spark, sf):
    return bigint(telemetry.combined_pods(load(spark)))


@query(f"WITH l AS ({LOAD_SQL} WHERE pod = 0), w AS (SELECT *, lag(p99_ms) OVER (ORDER BY step) AS before FROM l) SELECT CAST(min(step) AS BIGINT) AS step FROM w WHERE coalesce(p99_ms >= before * 2, false) OR errors > 0 OR dropped > 0")
def knee(spark, sf):
    return bigint(telemetry.knee(load(spark).filter("pod = 0")))


@query(f"WITH l AS ({LOAD_SQL}) SELECT min(start_s) AS from_s, CAST(max(ceil(start_s + seconds)) AS BIGINT) AS to_s FROM l")
def measured_window(spark, sf):
    return telemetry.measured_window(load(spark)).select("from_s", F.col("to_s").cast("long").alias("to_s"))


@query(f"WITH l AS ({LOAD_SQL}) SELECT CAST(pod AS BIGINT) AS pod, CAST(step AS BIGINT) AS step, dropped = 0 AND errors * 2 < 5 AND p99_ms / 20 <= 1.5 AS valid FROM l")
def valid_steps(spark, sf):
    return bigint(load(spark).select("pod", "step", telemetry.valid_run(F.col("dropped"), F.col("errors"), F.lit(5), F.col("p99_ms") / 20).alias("valid")))


@query(f"WITH l AS ({LOAD_SQL}), s AS (SELECT *, sum(count) OVER (ORDER BY step, pod) AS running FROM l) SELECT CAST(step AS BIGINT) AS step, CAST(pod AS BIGINT) AS pod, CAST(running AS BIGINT) AS running FROM s WHERE running <= 13000")
def ledger_guard(spark, sf):
    run = Window.orderBy("step", "pod")  # a row for each planned run
    return bigint(load(spark).withColumn("running", F.sum("count").over(run)).filter("running <= 13000").select("step", "pod", "running"))


@query(
    """WITH s AS (SELECT concat('t', user_id % 3) AS test, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS w, concat('kv-', user_id % 6) AS pod, max(event_id) AS created, min(event_id) AS delivered FROM events GROUP BY ALL)
SELECT a.test, a.pod, CAST(a.created - b.created AS BIGINT) AS created, CAST(a.delivered - b.delivered AS BIGINT) AS delivered FROM s a JOIN s b ON a.test = b.test AND a.pod = b.pod WHERE a.w = 'after' AND b.w = 'before'"""
)
def hint_snapshot_delta(spark, sf):
    e = table(spark, sf, "events")
    when = F.when(F.col("event_id") % 2 == 0, "before").otherwise("after").alias("when")
    shots = e.groupBy(F.concat(F.lit("t"), F.col("user_id") % 3).alias("test"), when, F.concat(F.lit("kv-"), F.col("user_id") % 6).alias("pod")).agg(F.max("event_id").alias("created"), F.min("event_id").alias("delivered"))
    return telemetry.snapshot_delta(shots)


@query(
    """WITH s AS (SELECT concat('kv-', user_id % 6) AS instance, count(*)::DOUBLE AS requests, (count(*) FILTER (WHERE event_type = 'error'))::DOUBLE AS errors, max(CASE WHEN user_id % 6 <> 2 THEN value END) AS largest FROM events GROUP BY 1)
SELECT instance, metric, value FROM (SELECT instance, 'requests' AS metric, requests AS value FROM s UNION ALL SELECT instance, 'errors', errors FROM s UNION ALL SELECT instance, 'largest', largest FROM s) WHERE value IS NOT NULL"""
)
def node_metrics(spark, sf):
    known = F.when(F.col("user_id") % 6 != 2, F.col("value"))
    stats = table(spark, sf, "events").groupBy(F.concat(F.lit("kv-"), F.col("user_id") % 6).alias("instance")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(known).alias("largest"))
    return telemetry.long_metrics(stats, ["instance"])


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) * 1.0::DOUBLE / count(*) AS ratio, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def flat_stats(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), telemetry.ratio(F.sum(F.when(F.col("value") > 100, 1.0).otherwise(0.0)), F.count("*")).alias("ratio"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


# Membership


@query("SELECT node, greatest(epoch, coalesce((SELECT max(b.epoch) FROM (VALUES ('a', 3), ('b', 1), ('c', 1), ('d', 2)) AS b(node, epoch) WHERE (v.node = 'b' AND b.node = 'a') OR (v.node = 'c' AND b.node IN ('b', 'a')) OR (v.node = 'd' AND b.node IN ('c', 'b'))), 0))::BIGINT AS epoch FROM (VALUES ('a', 3), ('b', 1), ('c', 1), ('d', 2)) AS v(node, epoch)")
def gossip_epochs(spark, sf):
    views = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1), ("d", 2)], "node string, epoch long")
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "node string, hears string")
    return membership.gossip(views, links, 2)


@query("SELECT s_suppkey AS id, (s_suppkey % 2 = 0) AND (s_suppkey % 3 = 0 OR (s_suppkey % 5 >= 2 AND s_suppkey % 7 >= 2)) AS drained FROM supplier")
def drain_condition(spark, sf):
    i = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(i.alias("id"), membership.drained(i % 2 == 0, i % 3 == 0, F.array(i % 5, i % 7), F.lit(2)).alias("drained"))


@query(
    """WITH g AS (SELECT s, e, c, desired, e + CASE WHEN c <> 0 THEN 1 ELSE 0 END AS ec FROM range(1, 7) AS a(s), range(1, 7) AS b(desired), (VALUES (0), (2)) AS d(e), (VALUES (-1), (0), (1)) AS f(c) WHERE s + c > 0)
SELECT CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(c AS BIGINT) AS c, CAST(desired AS BIGINT) AS desired,
 CASE WHEN c = 1 THEN 'ScaleStatefulSet' WHEN c = -1 THEN 'Wait' WHEN s < desired THEN 'WriteConfigMap' WHEN s > desired THEN 'PostMembership' ELSE 'None' END AS action,
 CASE WHEN c = -1 THEN 'Degraded' WHEN c = 1 OR s <> desired THEN 'Scaling' ELSE 'Ready' END AS phase,
 CASE WHEN c = 1 THEN 'AddingPod' WHEN c = -1 THEN 'UnexplainedDivergence' WHEN s < desired THEN 'AddingPod' WHEN s > desired THEN 'RemovingPod' ELSE 'Ready' END AS reason,
 CAST(CASE WHEN c = 0 AND s <> desired THEN ec + 1 END AS BIGINT) AS to_epoch, CAST(CASE WHEN c = 1 THEN s + 1 WHEN c = 0 AND s < desired THEN s + 1 WHEN c = 0 AND s > desired THEN s - 1 END AS BIGINT) AS to_size FROM g"""
)
def planner_decisions(spark, sf) -> DataFrame:
    """The planner over a grid of sizes, wishes and epochs, a row for each; its cases are in the tests."""
    grid = spark.sql("select s, d, e, c from (select explode(sequence(1, 6)) s), (select explode(sequence(1, 6)) d), (select explode(array(0, 2)) e), (select explode(array(-1, 0, 1)) c)").filter("s + c > 0")
    wanted = lambda n: F.map_from_entries(membership.wanted(F.lit("kv"), F.lit("kvstore"), n))
    view = F.struct(F.col("e").cast("long").alias("epoch"), wanted(F.col("s")).alias("members"), F.col("e").cast("long").alias("handoff_epoch"), F.lit(True).alias("handoff_done"))
    pod = lambda i: F.struct(i.alias("ordinal"), F.lit(True).alias("present"), F.lit(False).alias("terminating"), F.lit(True).alias("ready"), F.lit(0).cast("long").alias("since_s"), view.alias("membership"), F.lit(None).cast("long").alias("unreachable_since_s"), F.lit(None).cast("struct<epoch:bigint,drained:boolean,pending:int>").alias("drain"))
    obs = grid.select(
        "s", "e", "c", F.lit("kv").alias("cluster"), F.lit("kvstore").alias("namespace"), F.lit(1000).cast("long").alias("now_s"), F.col("d").alias("desired"), F.lit(120).cast("long").alias("grace_s"),
        F.lit(600).cast("long").alias("drain_timeout_s"), F.lit(None).cast("long").alias("drain_started_s"), F.lit("Ready").alias("prev_phase"),
        F.struct(F.col("s").alias("replicas"), F.col("s").alias("ready"), F.lit(True).alias("rolled_out"), F.lit(True).alias("template_current")).alias("sts"),
        F.struct((F.col("e") + F.when(F.col("c") != 0, 1).otherwise(0)).cast("long").alias("epoch"), wanted(F.col("s") + F.col("c")).alias("members"), F.lit(None).cast("string").alias("invalid")).alias("cm"),
        F.transform(F.sequence(F.lit(0), F.col("s") - 1), pod).alias("pods"), F.sequence(F.lit(0), F.col("s") - 1).alias("pvcs"),
    )
    return bigint(membership.plan(obs).select("s", "e", "c", "desired", "action", "phase", "reason", "to_epoch", "to_size"))
