"""Sinks: sorted Parquet layers with bloom filters, manifests, JSON lines, CSV, and the text report."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.operators import chaos


def write_layer(df: DataFrame, path: str, key: str = "key", order: str = "seq", expected_keys: int = 1_000_000) -> None:
    """An immutable layer: range-partitioned and sorted by key, newest sibling first, with a bloom filter on the key; nothing is no layer."""
    if df.isEmpty():
        raise ValueError("a layer has at least one entry")
    out = df.repartitionByRange(key).sortWithinPartitions(key, F.desc(order))
    out.write.mode("errorifexists").option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.bloom.filter.expected.ndv#" + key, str(expected_keys)).parquet(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """(seq, op, id) rows in one commit."""
    df.select(F.col("seq").cast("long").alias("seq"), "op", "id").coalesce(1).write.mode("append").parquet(path)


def register(spark: SparkSession, manifest: str, added: list[str], removed: list[str]) -> None:
    """Register layers and retire others in one commit of the manifest: readers see all of it or nothing."""
    last = spark.read.parquet(manifest).agg(F.max("seq")).first()[0] if exists(spark, manifest) else None
    ops = [("ADD", i) for i in added] + [("REMOVE", i) for i in removed]
    append_manifest(spark.createDataFrame([((last or 0) + n, op, i) for n, (op, i) in enumerate(ops, 1)], "seq long, op string, id string"), manifest)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_log(entries: DataFrame, path: str, segment: str = "segment", order: str = "seq") -> DataFrame:
    """Write entries (segment, seq, json) as log segments, a file each: length, CRC-32 and payload of every record, in order.

    Returns (segment, records). One task writes a segment's file, from rows that Spark has sorted (which spills), so its
    memory doesn't grow with the segment; a task that runs again writes the same bytes under the same name.
    """

    def run(batches):
        number = out = system = None
        records = 0
        try:
            for batch in batches:
                for segment, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if segment != number:
                        if out is not None:
                            out.close()
                            yield counted(number, records)
                        system, at = fs.FileSystem.from_uri(path)
                        system.create_dir(at, recursive=True)
                        out = system.open_output_stream(f"{at}/wal_{segment:020d}.log", buffer_size=1 << 20)
                        number, records = segment, 0
                    body = body.as_py().encode()
                    out.write(len(body).to_bytes(4, "big") + zlib.crc32(body).to_bytes(4, "big") + body)
                    records += 1
        finally:
            if out is not None:
                out.close()
        if number is not None:
            yield counted(number, records)

    def counted(number: int, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([records], pa.int64())], names=["segment", "records"])

    given = entries.select(F.col(segment).cast("long").alias("segment"), F.col(order).cast("long").alias("seq"), "json")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that no partition is dealt anew
    return given.repartition(parts, "segment").sortWithinPartitions("segment", "seq", "json").select("segment", "json").mapInArrow(run, "segment long, records long")


def drop_segments(spark: SparkSession, path: str, through: int) -> None:
    """Delete the log segments up to one whose entries are in a layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(at):
        name = status.getPath().getName()
        number = 0 if name == "wal.log" else int(name[4:24]) if name.startswith("wal_") else None
        if number is not None and number <= through:
            files.delete(status.getPath(), False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def per_key_predictions(each: DataFrame, zones: dict[str, str]) -> DataFrame:
    """Predictions of one fault as a row for each key: replicas, zones, and expect by side and op."""
    zone = F.create_map(*[F.lit(x) for kv in zones.items() for x in kv])
    by_op = each.groupBy("key", "owners", "side").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "expect")))).alias("ops"))
    by = by_op.groupBy("key", "owners").agg(F.map_from_entries(F.collect_list(F.struct("side", "ops"))).alias("expect"))
    return by.select("key", F.col("owners").alias("replicas"), F.transform("owners", lambda o: zone[o]).alias("zones"), "expect")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def report_text(rows: DataFrame, lines: DataFrame, report: DataFrame | None, lost: DataFrame | None = None) -> str:
    """The check's report: a few lines for each test, from aggregates that have a row for each test, phase and bucket."""
    counts: dict[str, dict] = {}
    for r in chaos.phase_counts(rows).orderBy("test", "phase", "op", "result").collect():
        counts.setdefault(r.test, {}).setdefault((r.phase, r.op), []).append(f"{r.result}={r.n}")
    buckets: dict[str, list[str]] = {}
    for r in chaos.bucket_counts(rows).orderBy("test", "bucket").collect():
        buckets.setdefault(r.test, []).append(f"{'!' if r.bucket in chaos.VIOLATIONS else ''}{r.bucket}={r.n}")
    faults = {r.test: r for r in lines.select("test", "fault", "inject", "heal").collect()}
    hints = {r.test: r for r in chaos.hint_totals(rows).collect()}
    out = []
    for test in sorted(counts):
        f = faults.get(test)
        out.append(f"== test {test}" + (f": {f.fault}, injected at {f.inject} ns" + (f", healed after {(f.heal - f.inject) / 1e9:.0f}s" if f.heal else "") if f else ""))
        for phase in ("normal", "transition", "fault"):
            for op in ("put", "get"):
                if told := counts[test].get((phase, op)):
                    out.append(f"  {phase:<10} {op:<3}  {' '.join(told)}")
        out.append(f"  compared:  {' '.join(buckets[test])}")
        if f:
            h = hints[test]
            out.append(f"  predicted: hints {h.hints} to {h.hints + h.hints_maybe}" + (f" (+ up to {h.hints_unknown} through the Service)" if h.hints_unknown else "") + f"; under-replicated until anti-entropy {h.under_replicated}")
    if report is None:
        out.append("== read-back: none given")
        ok = not any(b.startswith("!") for bs in buckets.values() for b in bs)
    else:
        r = report.first()
        out.append(f"== read-back: {r.acked} acknowledged writes: lost {r.lost}, not read back {r.not_read_back}, unreadable {r.unreadable}")
        out += [f"  LOST {k.key}" for k in (lost.collect() if lost is not None else [])]
        out.append(f"  unacknowledged writes: present {r.unacked_present}, absent {r.unacked_absent} (either is allowed)")
        if r.copies_checked:
            out.append(f"  copies: {r.copies_checked} checked, {r.under_replicated} on fewer than all owners: {r.under_replicated_expected} predicted, {r.under_replicated_unexpected} not")
        ok = chaos.verdict(rows, report).first().ok
    return "\n".join([*out, "== PASS" if ok else "== FAIL"]) + "\n"


def predict_text(shares: DataFrame, summary: DataFrame) -> str:
    """The prediction's table: shares of keys, then failing keys by fault and side; a row for each member and fault."""
    out = [f"  {r.pod} holds {100 * r.share:5.1f}%" for r in shares.orderBy("pod").collect()]
    rows: dict[tuple[str, str], dict] = {}
    for r in summary.collect():
        rows.setdefault((r.fault, r.side), {})[r.op] = r
    for (fault, side), ops in sorted(rows.items()):
        if side != "nowhere" or fault.startswith("partition"):
            out.append(f"{fault:<40} " + " ".join(f"{ops[o].fails:9d} ({100 * ops[o].fails / ops[o].keys:5.1f}%)" for o in ("put", "get")) + f"  {'both sides' if side == 'nowhere' else side}")
    return "\n".join(out) + "\n"


def write_text(path: str, text: str) -> None:
    """Replace a small file in one step."""
    import os

    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def metrics_text(rows: DataFrame, labels: list[str]) -> str:
    """Long metrics (labels, metric, value) in exposition format; a snapshot has a few rows."""
    return "".join(f"{r.metric}{{{','.join(f'{k}={json.dumps(r[k])}' for k in labels)}}} {r.value:g}\n" for r in rows.orderBy("metric", *labels).collect())
