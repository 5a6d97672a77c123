"""Streams over files against their batch forms."""

from pyspark.sql import functions as F

from quorumlens.operators import telemetry
from quorumlens.streaming import stateful


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_failure_detector(spark, tmp_path):
    rows = [("a", f"p{s % 3}", s, (s // 3) % 7 < 3) for s in range(120)]
    df = spark.createDataFrame(rows, "observer string, peer string, seq long, ok boolean")
    df.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    got = {(r.peer, r.seq) for r in drained(spark, stateful.failure_detector(stream), "detector").filter("dead").collect()}
    want = {(r.peer, r.dead_from) for r in telemetry.dead_spells(df).collect()}
    assert got == want and got


def test_versioned_puts(spark, tmp_path):
    schema = "key string, seq long, node string, value_json string, context map<string,bigint>, is_deleted boolean"
    rows = [("k", 1, "a#1", "1", None, False), ("k", 2, "b#1", "2", {}, False), ("k", 3, "a#1", "3", {}, False), ("k", 4, "a#1", "4", None, False), ("none", 5, "a#1", None, None, True)]
    spark.createDataFrame(rows, schema).repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    got = {r.seq: (r.clock, r.siblings, r.applied) for r in drained(spark, stateful.versioned_puts(stream), "puts").collect()}
    # an explicit empty context makes {a#1: 1} again, equal to what is there: acknowledged, and dropped
    assert got == {1: ({"a#1": 1}, 1, True), 2: ({"b#1": 1}, 2, True), 3: ({"a#1": 1}, 2, False), 4: ({"a#1": 2, "b#1": 1}, 1, True)}


def test_flushed_layers(spark, tmp_path):
    schema = "key string, seq long, value_json string, clock map<string,bigint>, is_deleted boolean"
    for i in range(3):
        spark.createDataFrame([(f"k{j % 4}", 10 * i + j, str(j), {"a": i + 1, "b": j}, False) for j in range(6)], schema).repartition(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    path = str(tmp_path / "layers")
    q = stream.writeStream.foreachBatch(stateful.flush_to_layers(path, 1)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(path).select("layer").distinct().count() == 3
    from quorumlens.operators.versions import survivors

    want = {(r.key, r.seq) for r in survivors(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    assert {(r.key, r.seq) for r in stateful.visible(spark, path).collect()} == want


def test_hints(spark, tmp_path):
    schema = "target string, key string, clock map<string,bigint>, delivered boolean"
    spark.createDataFrame([("t", "a", {"x": 1}, False), ("t", "a", {"x": 2}, False), ("t", "b", {"x": 1}, False), ("t", "a", {"x": 2}, True)], schema).repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    rows = drained(spark, stateful.hint_state(stream), "hints", "update").select("target", "key", F.col("pending")).collect()
    assert sorted(map(tuple, rows)) == [("t", "a", 0), ("t", "b", 1)]
