"""Readers of logs, timelines, topologies, metrics and key lists: explicit schemas, strict where a bad line is an error."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions.hashes import fingerprint_py
from quorumlens.functions.scalars import detection_ns, duration_ns_py, key_name, recovery_ns, rfc3339_ns
from quorumlens.operators.chaos import Topology

REQUEST = "test string, seq long, op string, key string, target string, start long, end long, result string, code string, msg string"
EVENT = "time string, test string, event string, fault string, mark string"
READBACK = "key string, time long, target string, result string, code string, msg string, owners array<string>, holders array<string>, unreadable array<string>"
STEPS = "pod int, step int, op string, target_rate double, seconds int, started long, achieved_rate double, count long, p50_ms double, p95_ms double, p99_ms double, max_ms double, errors long, dropped long"
LOG_ENTRY = "Key string, Value string, VectorClock map<string,bigint>, LastUpdatedBy string, IsDeleted boolean, Op tinyint, Items array<struct<Value:string,VectorClock:map<string,bigint>,LastUpdatedBy:string,IsDeleted:boolean>>"
HEADER = 8  # fixed value: bytes of a log record's length and checksum
HELD = 4_000_000  # bytes of log records after which a task passes them on


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One JSON document a line; blank lines are skipped, anything else that doesn't parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def requests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_lines(spark, paths, REQUEST)


def events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Fault timelines with time_ns."""
    return json_lines(spark, paths, EVENT).withColumn("time_ns", rfc3339_ns(F.col("time")))


def readbacks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read-backs with the sizes that the report compares; line order settles equal times."""
    rows = json_lines(spark, paths, READBACK).withColumn("pass", F.monotonically_increasing_id())
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.withColumnRenamed("time", "time_ns").withColumns({"n_owners": F.greatest(F.lit(0), size("owners")), "n_holders": F.greatest(F.lit(0), size("holders"))})


def topology(text: str) -> Topology:
    """A topology document: members with zones, the quorum, and timing; one whose fingerprint is of another ring is refused."""
    told = json.loads(text)
    t = told["timing"]
    beat, wait = duration_ns_py(t["heartbeatInterval"]), duration_ns_py(t["heartbeatTimeout"])
    zones = {p["id"]: p["zone"] for p in told["pods"]}
    if len(zones) != len(told["pods"]):
        raise ValueError("a member is listed twice")
    if "fingerprint" in told:
        want = fingerprint_py({p["id"]: p["address"] for p in told["pods"]}, told["n"])
        if told["fingerprint"] != want:
            raise ValueError(f"fingerprint {told['fingerprint']!r}, but these members give {want!r}: the ring is not the one built here")
    return Topology(zones, told["n"], told["w"], told["r"], detection_ns(beat, wait, t["maxMissedHeartbeats"]), recovery_ns(duration_ns_py(t["maxReconnectBackoff"]), beat, wait))


def members_problems(members: DataFrame, n: int) -> DataFrame:
    """(problem) of a member table (id, address): fewer than n, empty or reserved ids, addresses used twice."""
    odd = members.filter((F.col("id") == "") | (F.col("address") == "") | F.col("id").rlike("[#\\x00]")).select(F.concat(F.lit("odd member "), "id").alias("problem"))
    twice = members.groupBy("address").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("address used twice: "), "address").alias("problem"))
    few = members.agg(F.count("*").alias("n")).filter(F.col("n") < n).select(F.lit(f"fewer than {n} members").alias("problem"))
    return odd.unionByName(twice).unionByName(few)


def placed_pods(pods: DataFrame, nodes: DataFrame, members: DataFrame, views: DataFrame) -> DataFrame:
    """Pods (id, node) with zone and address, from nodes (node, zone) and members (id, address), and error where views (id, epoch, fingerprint) disagree or anything is missing."""
    agreed = views.agg(F.count_distinct(F.struct("epoch", "fingerprint")).alias("held"))
    both = pods.join(nodes, "node", "left").join(members, "id", "left").join(views.select("id", "epoch"), "id", "left").crossJoin(agreed)  # one row
    error = F.when(F.col("zone").isNull(), "no zone").when(F.col("address").isNull(), "not a member").when(F.col("epoch").isNull(), "no membership").when(F.col("held") > 1, "memberships differ")
    return both.withColumn("error", error).drop("held")


def keys(spark: SparkSession, spec: str) -> DataFrame:
    """PREFIX:COUNT as that many keys."""
    prefix, _, count = spec.partition(":")
    if not prefix or not count.isdigit() or int(count) <= 0:
        raise ValueError(f"keys {spec!r}: want PREFIX:COUNT")
    return spark.range(int(count)).select(key_name(F.lit(prefix), F.col("id")).alias("key"))


def key_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("key")).filter("key <> ''")


def steps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(STEPS).option("header", True).csv(paths)


def rate_chart(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rate against p99 of several ramps, by the file that each step is from."""
    rows = steps(spark, paths).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))
    return rows.select("run", F.col("target_rate").alias("rate"), "p99_ms").orderBy("run", "rate")


def metric_samples(spark: SparkSession, paths: str | list[str], labels: list[str]) -> DataFrame:
    """Exported metrics: time, the given label columns, value."""
    schema = ", ".join(["time string", *[f"`{x}` string" for x in labels], "value double"])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(paths).withColumn("time_us", F.unix_micros(F.to_timestamp("time")))


PROMETHEUS = "status string, data struct<resultType:string, result:array<struct<metric:map<string,string>, values:array<array<string>>, value:array<string>>>>"


def prometheus(answers: DataFrame, text: str = "text") -> DataFrame:
    """(metric map, time_us, value) of answers to range and instant queries, a JSON document a row; any that isn't a success fails the job."""
    told = answers.select(F.from_json(text, PROMETHEUS).alias("a"))
    good = F.when(F.col("a.status") == "success", F.col("a.data.result")).otherwise(F.raise_error(F.lit("a query failed")).cast("array<struct<metric:map<string,string>, values:array<array<string>>, value:array<string>>>"))
    series = told.select(F.explode(good).alias("s")).select("s.metric", F.explode(F.coalesce("s.values", F.array("s.value"))).alias("p"))
    return series.select("metric", F.round(F.col("p")[0].cast("double") * 1_000_000).cast("long").alias("time_us"), F.col("p")[1].cast("double").alias("value"))


def hint_counters(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    rows = spark.read.text(path).filter("value <> ''")
    return rows.select(parts[0].alias("time"), parts[1].alias("test"), parts[2].alias("when"), parts[3].alias("pod"), parts[4].cast("long").alias("created"), parts[5].cast("long").alias("delivered"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(seq, op, id) of a manifest file; a last line without its end doesn't count. A manifest is one small file."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.slice(F.split("value", "\n"), 1, F.size(F.split("value", "\n")) - 1)
    rows = whole.select(F.posexplode(lines).alias("line", "text"))
    words = rows.select("line", F.split("text", " ").alias("w")).filter(F.col("w")[0].isin("ADD", "REMOVE"))
    return words.select("line", F.col("w")[0].alias("op"), F.posexplode(F.slice("w", 2, F.size("w"))).alias("place", "id")).select((F.col("line").cast("long") * 1_000_000 + F.col("place")).alias("seq"), "op", "id")


def log_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(segment, path, content) of a log folder: wal_ and 20 digits, or wal.log as segment 0; empty files are left out.

    content is null where Arrow opens the folder itself, so that segments of any size are read bit by bit.
    """
    from pyarrow import fs

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    try:
        fs.FileSystem.from_uri("/" if whole.startswith("file:") else whole)
        content = F.lit(None).cast("binary")
    except (ValueError, OSError, ImportError):
        content = F.col("content")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal*").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    number = F.when(name == "wal.log", 0).otherwise(F.regexp_extract(name, r"^wal_(\d{20})", 1).try_cast("long"))
    return files.filter("length > 0").select(number.alias("segment"), "path", content.alias("content")).filter("segment is not null")


def log_entries(segments: DataFrame) -> DataFrame:
    """(segment, place, entry...) of the log records before the first torn one of each segment.

    Records are found by walking lengths, which is sequential within a segment; a task holds some records at a time.
    """
    import pyarrow as pa

    def run(batches):
        import io
        import zlib

        from pyarrow import fs

        def opened(path, content):
            if content is not None:
                return io.BytesIO(content), len(content)
            system, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            return system.open_input_stream(at, buffer_size=1 << 20), system.get_file_info(at).size

        def told(segment, first, bodies):
            n = len(bodies)
            return pa.RecordBatch.from_arrays([pa.array([segment] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(bodies, pa.string())], names=["segment", "place", "json"])

        for batch in batches:
            for segment, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                stream, left = opened(path, content)
                with stream:
                    place, bodies, held = 0, [], 0
                    while left >= HEADER:
                        head = stream.read(HEADER)
                        size, crc = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:], "big")
                        left -= HEADER + size
                        if left < 0 or len(body := stream.read(size)) < size or zlib.crc32(body) != crc:
                            break
                        bodies.append(body.decode("utf-8", "replace"))
                        held += size
                        if len(bodies) >= 10_000 or held >= HELD:
                            yield told(segment, place, bodies)
                            place, bodies, held = place + len(bodies), [], 0
                    yield told(segment, place, bodies)

    raw = segments.select(F.col("segment").cast("long").alias("segment"), "path", "content").mapInArrow(run, "segment long, place long, json string")
    return raw.select("segment", "place", F.from_json("json", LOG_ENTRY, {"mode": "FAILFAST"}).alias("e")).select("segment", "place", "e.*")


def log_versions(entries: DataFrame) -> DataFrame:
    """Log entries as a change log: a put is one version, a restore one row for each version that it sets, in order.

    A restore of nothing is a row without a value that only replaces what was there; any other operation fails the job.
    """
    op = F.coalesce("Op", F.lit(0))
    known = F.when(op.isin(0, 1), op).otherwise(F.raise_error(F.concat(F.lit("unknown log operation "), op.cast("string"))).cast("int"))
    item = F.array(F.struct("Value", "VectorClock", "LastUpdatedBy", "IsDeleted"))
    rows = entries.withColumn("op", known).withColumn("items", F.when(F.col("op") == 0, item).otherwise(F.col("Items")))
    rows = rows.select("segment", "place", F.col("Key").alias("key"), "op", F.posexplode_outer("items").alias("n", "i"))
    seq = F.struct("segment", "place", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.select("key", seq.alias("seq"), F.struct("segment", "place", F.lit(0).alias("n")).alias("entry"), F.col("i.Value").alias("value_json"), F.col("i.VectorClock").alias("clock"), F.col("i.LastUpdatedBy").alias("last_updated_by"), F.coalesce("i.IsDeleted", F.lit(False)).alias("is_deleted"), (F.col("op") == 1).alias("is_restore"))
