"""Layered, log-structured storage: the manifest, visible state, tiers and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions.scalars import size_tier
from quorumlens.operators.versions import survivors

RUN = 4
OVERHEAD = 64


def live_files(manifest: DataFrame) -> DataFrame:
    """File ids whose last operation (seq, op, id) is ADD."""
    return manifest.groupBy("id").agg(F.max_by("op", "seq").alias("op")).filter("op = 'ADD'").select("id")


def ranked_files(live: DataFrame, first: int = 2) -> DataFrame:
    """Live files with layer_rank, newest (largest id) first; files are metadata, a row each."""
    return live.withColumn("layer_rank", F.row_number().over(Window.orderBy(F.desc("id"))) + (first - 1))


def visible(layers: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The state that all layers show together: newer layers win ties, and within a layer the earlier version."""
    return survivors(layers, keys, order=("layer_rank", "seq"))


def keys_of(layers: DataFrame) -> DataFrame:
    return layers.select("key").distinct()


def size_by_layer(layers: DataFrame, value: str = "value_json") -> DataFrame:
    """Estimated bytes of each layer in memory."""
    each = F.octet_length("key") + F.octet_length(F.col(value)) + OVERHEAD
    return layers.groupBy("layer_rank").agg(F.count("*").alias("entries"), F.sum(each.cast("long")).alias("bytes"))


def tier_runs(files: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring files (newest_rank, id, size) of one tier: islands over the file list."""
    order = Window.orderBy("newest_rank")
    tiered = files.withColumn("tier", size_tier(F.col("size")))
    new = F.coalesce(F.col("tier") != F.lag("tier").over(order), F.lit(True)).cast("int")
    runs = tiered.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("run", "tier").agg(F.count("*").alias("n"), F.min("newest_rank").alias("from_rank"), F.max("newest_rank").alias("to_rank"))


def chosen_run(files: DataFrame, least: int = RUN) -> DataFrame:
    """The run to compact: the longest of at least so many files, of equal ones the newest; no row if there is none."""
    return tier_runs(files).filter(F.col("n") >= least).orderBy(F.desc("n"), "from_rank").limit(1)


def compacted(layers: DataFrame, lo: int, hi: int) -> DataFrame:
    """The entries of layers lo to hi merged: siblings and tombstones stay, sorted by key, newest siblings first."""
    merged = visible(layers.filter(F.col("layer_rank").between(lo, hi)))
    return merged.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))


def compacted_id(newest: str) -> str:
    """The id of a compaction's output: it sorts where its newest source did."""
    return f"{newest}_c"


def first_sibling(layers: DataFrame) -> DataFrame:
    rest = [c for c in layers.columns if c != "key"]
    return layers.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("layer_rank", -F.col("seq"))).alias("r")).select("key", "r.*")
