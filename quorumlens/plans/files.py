"""The readers and sinks in the catalogue: what a query derives is written, read back, and must be what the SQL says."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlens.functions.hashes import bucket_for
from quorumlens.operators import chaos, layers, placement, versions
from quorumlens.plans.catalogue import PODS, TOPOLOGY, bigint, fnv, keys, placed, query, requests, ring, table, w1, w2
from quorumlens.plans.fixtures import fixture, with_clause
from quorumlens.plans.more import LOAD_SQL, load
from quorumlens.sources import logs, scratch, sinks


@query(f"{with_clause('W2')} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1 AS ord FROM W2 WHERE layer_rank = 0")
def layer_scan(spark, sf):
    """A layer written and scanned whole, with each entry's place among its key's."""
    path = scratch.folder(spark, "layer")
    sinks.write_layer(w2(spark, sf).filter("layer_rank = 0"), path)
    return bigint(versions.newest_first(spark.read.parquet(path)).select("key", "seq", "ord"))


@query(f"{with_clause('W2')} SELECT key, seq, value FROM W2 WHERE layer_rank = 1 AND key IN ('part-7', 'part-70', 'none')")
def layer_point_read(spark, sf):
    """A point read of a written layer: file statistics and the bloom filter pass over what can't hold the key."""
    path = scratch.folder(spark, "layer")
    sinks.write_layer(w2(spark, sf).filter("layer_rank = 1"), path)
    return spark.read.parquet(path).filter(F.col("key").isin("part-7", "part-70", "none")).select("key", "seq", "value")


@query(f"{with_clause('MAN')}, l AS (SELECT id, arg_max(op, seq) AS op FROM (SELECT * FROM MAN UNION ALL SELECT * FROM (VALUES (11, 'ADD', 'sst_006'), (12, 'REMOVE', 'sst_005'), (13, 'REMOVE', 'sst_004_c')) AS m(seq, op, id)) GROUP BY id) SELECT id FROM l WHERE op = 'ADD'")
def manifest_commits(spark, sf):
    """Layers registered and retired in one commit each."""
    path = scratch.folder(spark, "manifest")
    sinks.append_manifest(fixture(spark, sf, "MAN"), path)
    sinks.register(spark, path, ["sst_006"], ["sst_005", "sst_004_c"])
    return layers.live_files(spark.read.parquet(path))


@query(f"{with_clause('W1')}, l AS (SELECT {fnv('key')} % 4 + 1 AS segment, key, seq FROM W1) SELECT CAST(segment AS BIGINT) AS segment, count(*) AS n, count(DISTINCT key) AS keys FROM l WHERE segment > 2 GROUP BY segment")
def log_segments(spark, sf):
    """Log records written in segments, the first two dropped once they are flushed, the rest read back and checked."""
    path = scratch.folder(spark, "log")
    rows = w1(spark, sf).withColumn("segment", bucket_for(F.col("key"), 4) + 1)
    entry = F.to_json(F.struct(F.col("key").alias("Key"), F.col("seq").cast("string").alias("Value"), F.col("clock").alias("VectorClock"), F.col("node").alias("LastUpdatedBy"), F.col("is_deleted").alias("IsDeleted")))
    written = sinks.append_log(rows.select("segment", "seq", entry.alias("json")), path)
    written.write.format("noop").mode("overwrite").save()
    sinks.drop_segments(spark, path, 2)
    back = logs.log_versions(logs.log_entries(logs.log_segments(spark, path)))
    return back.groupBy(F.col("seq.segment").alias("segment")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(f"{with_clause('Q1')} SELECT test, op, result, target, count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS spent FROM Q1 GROUP BY ALL")
def request_records(spark, sf):
    """Request records as JSON lines and back."""
    path = scratch.folder(spark, "records")
    sinks.write_json_lines(requests(spark, sf).withColumns({"code": F.lit(None).cast("string"), "msg": F.lit("")}), path)
    back = logs.requests(spark, path)
    return back.groupBy("test", "op", "result", "target").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("spent"))


@query(f"{with_clause('T')} SELECT test, event, fault, mark, time_ns FROM T")
def timeline_records(spark, sf):
    """A fault timeline as JSON lines with RFC 3339 times, blank lines among them, and back."""
    path = scratch.folder(spark, "timeline")
    time = F.date_format(F.timestamp_micros(F.floor(F.col("time_ns") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = fixture(spark, sf, "T").select(F.concat(F.to_json(F.struct(time.alias("time"), "test", "event", "fault", "mark")), F.lit("\n")).alias("value"))
    lines.write.text(path)  # each line is followed by an empty one
    return logs.events(spark, path).select("test", "event", "fault", "mark", "time_ns")


@query(f"{with_clause('RBK')} SELECT key, time_ns, result, CAST(n_owners AS BIGINT) AS n_owners, CAST(n_holders AS BIGINT) AS n_holders FROM RBK")
def readback_records(spark, sf):
    """Read-backs with their lists of owners and holders as JSON lines and back."""
    path = scratch.folder(spark, "readback")
    some = lambda n: F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.concat(F.lit("kv-"), i))
    rows = fixture(spark, sf, "RBK").select("key", F.col("time_ns").alias("time"), F.lit("kv-0").alias("target"), "result", some("n_owners").alias("owners"), some("n_holders").alias("holders"))
    sinks.write_json_lines(rows, path)
    return bigint(logs.readbacks(spark, path).select("key", "time_ns", "result", "n_owners", "n_holders"))


@query(f"WITH l AS ({LOAD_SQL}) SELECT CAST(pod AS BIGINT) AS pod, CAST(step AS BIGINT) AS step, op, target_rate, CAST(count AS BIGINT) AS count, p99_ms, CAST(errors AS BIGINT) AS errors, CAST(dropped AS BIGINT) AS dropped FROM l")
def steps_table(spark, sf):
    """Load steps as CSV and back."""
    path = scratch.folder(spark, "steps")
    told = {"started": F.col("count"), "p50_ms": F.lit(1.5), "p95_ms": F.lit(2.5), "max_ms": F.col("p99_ms")}
    rows = load(spark).withColumns(told)
    sinks.write_csv(rows.select([c.split()[0] for c in logs.STEPS.split(", ")]), path, ["pod", "step"])
    return bigint(logs.steps(spark, path).select("pod", "step", "op", "target_rate", "count", "p99_ms", "errors", "dropped"))


@query("SELECT s_name AS key, count(*) AS n FROM supplier GROUP BY 1")
def key_list(spark, sf):
    """Keys in a text file, several on a line between any white space, and back."""
    path = scratch.folder(spark, "keys")
    rows = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 10).alias("line")).agg(F.concat_ws("\t ", F.collect_list("s_name")).alias("value"))
    rows.select(F.concat(F.lit("  "), "value", F.lit(" ")).alias("value")).write.text(path)
    return logs.key_file(spark, path).groupBy("key").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ring('six', PODS)}, {keys('k', 'supplier', 's_name')}, {placed('p', 'k', 'six')}
SELECT key, array_to_string(owners, ',') AS replicas, CASE WHEN len(list_intersect(owners, ['kv-1', 'kv-4'])) >= 2 THEN 'ok' ELSE 'fail' END AS group_get, CASE WHEN len(owners) - len(list_intersect(owners, ['kv-1', 'kv-4'])) >= 2 THEN 'ok' ELSE 'fail' END AS rest_get FROM p"""
)
def prediction_records(spark, sf):
    """A fault's predictions by key as JSON lines and back."""
    path = scratch.folder(spark, "predictions")
    faults = chaos.faults_frame(spark, TOPOLOGY, [("partition", ["kv-1", "kv-4"])])
    each = chaos.predictions(placement.owners_of(table(spark, sf, "supplier").select(F.col("s_name").alias("key")), PODS, 3), faults, TOPOLOGY)
    sinks.write_json_lines(sinks.per_key_predictions(each, TOPOLOGY.zones), path)
    back = spark.read.schema("key string, replicas array<string>, zones array<string>, expect map<string,map<string,string>>").json(path)
    return back.select("key", F.array_join("replicas", ",").alias("replicas"), F.col("expect")["group"]["get"].alias("group_get"), F.col("expect")["rest"]["get"].alias("rest_get"))


@query(f"WITH l AS ({LOAD_SQL}) SELECT 'run-' || i AS run, target_rate AS rate, p99_ms + i AS p99_ms FROM l, range(3) AS r(i) WHERE pod = 0")
def rate_chart(spark, sf):
    """Rate against p99 of three ramps' tables, each told apart by its folder."""
    base = scratch.folder(spark, "charts")
    told = {"started": F.col("count"), "p50_ms": F.lit(1.5), "p95_ms": F.lit(2.5), "max_ms": F.col("p99_ms")}
    for i in range(3):
        rows = load(spark).filter("pod = 0").withColumns(told).withColumn("p99_ms", F.col("p99_ms") + i)
        sinks.write_csv(rows.select([c.split()[0] for c in logs.STEPS.split(", ")]), f"{base}/run-{i}", ["pod", "step"])
    return logs.rate_chart(spark, [f"{base}/run-{i}" for i in range(3)])
