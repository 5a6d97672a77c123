"""Sharding by extendible hashing: the directory is indexed by hash-prefix bits.

A bucket is a prefix of the 60-bit hash of a document's id and text. Bytes are summed by the longest
prefix of a round (15 bits more in each), and the sums of shorter prefixes follow from those. A
bucket over its byte limit splits on the next bit, and only such a bucket; a shard is the shortest
prefix that fits. What still doesn't fit goes to the next round. Rows equal in id and text have one
hash; where those alone exceed the limit, the bucket gets overflow pages of as many rows as fit.

Defined results: a null text has 0 bytes; one document over the limit is a shard of its own, marked
oversized; an empty table gives an empty table; columns named like a result are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlens.llm.common import materialise, quoted, replacing, table
from quorumlens.llm.mixing import KEY_BITS, random_key

SHARD_BYTES = 2 << 20
ROUND_BITS = 15


def directory(cells: DataFrame, parent_bits: int, bits: int, limit: int) -> DataFrame:
    """cells (cell, bytes, n, low, high) of prefixes of bits, with depth, shard_bytes, shard_n and single of the bucket that each is in.

    depth is null where the bucket has to split on further bits.
    """
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(parent_bits), F.lit(bits))))
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    sums = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_n"), F.min("low").alias("low"), F.max("high").alias("high"))
    fit = sums.withColumn("single", F.col("low") == F.col("high")).filter((F.col("shard_bytes") <= limit) | F.col("single"))
    found = levels.withColumn("prefix", prefix).join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_n", "single")).alias("s"))
    return cells.join(found, "cell", "left").select("cell", "s.*")


def shards(df: DataFrame, limit: int = SHARD_BYTES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with shard (depth-prefix, or depth-prefix+page), shard_depth, n_bytes, shard_bytes and oversized."""
    names = ["shard", "shard_depth", "n_bytes", "shard_bytes", "oversized"]
    rows = replacing(df, names).withColumns({"__ql_key": random_key(F.col(quoted(doc_id)), F.col(quoted(text))), "n_bytes": F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long")})
    left, done, at = materialise(rows.select("__ql_key", "n_bytes"), "keys"), [], 0
    every = []  # (bits, directory) of each round
    while True:
        bits = min(KEY_BITS, at + ROUND_BITS)
        cells = left.groupBy(F.shiftright("__ql_key", KEY_BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("__ql_key").alias("low"), F.max("__ql_key").alias("high"))
        found = materialise(directory(cells, at, bits, limit), f"directory-{bits}")
        every.append((bits, found))
        open_ = found.filter("depth is null")
        if bits == KEY_BITS or not open_.limit(1).count():
            break
        left = materialise(left.withColumn("cell", F.shiftright("__ql_key", KEY_BITS - bits)).join(open_.select("cell"), "cell", "left_semi").drop("cell"), f"keys-{bits}")
        at = bits
    for i, (bits, found) in enumerate(every):
        own = found.withColumnsRenamed({c: f"__ql_{c}" for c in found.columns})
        # the first directory has 2**15 cells at most; later ones only those of buckets still too large
        joined = rows.withColumn("__ql_at", F.shiftright("__ql_key", KEY_BITS - bits)).join(F.broadcast(own) if i == 0 else own, F.expr("__ql_at = __ql_cell"), "inner").drop("__ql_at", "__ql_cell")
        done.append(joined.filter("__ql_depth is not null"))
        rows = joined.filter("__ql_depth is null").select(*rows.columns)
    out = reduce(DataFrame.unionByName, done)
    pages = any(f.filter(f"single and shard_n > 1 and shard_bytes > {limit}").limit(1).count() for _, f in every)
    shard = F.concat_ws("-", F.col("__ql_depth"), F.col("__ql_prefix"))
    if not pages:
        out = out.withColumns({"shard": shard, "shard_bytes": F.col("__ql_shard_bytes")})
    else:
        full = f"__ql_single and __ql_shard_n > 1 and __ql_shard_bytes > {limit}"
        plain = out.filter(f"not ({full})").withColumns({"shard": shard, "shard_bytes": F.col("__ql_shard_bytes")})
        out = plain.unionByName(paged(materialise(out.filter(full), "overflow"), limit, shard))
    out = out.withColumns({"shard_depth": F.col("__ql_depth").cast("int"), "oversized": F.col("shard_bytes") > limit})
    return out.select(*[F.col(quoted(c)) for c in replacing(df, names).columns], *names)


def paged(rows: DataFrame, limit: int, shard) -> DataFrame:
    """Rows of buckets with one hash each, numbered part by part of their table and dealt to pages of as many as fit."""
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    rows = rows.withColumns({"__ql_part": F.spark_partition_id(), "__ql_row": F.monotonically_increasing_id()})
    rows = materialise(rows, "overflow-parts")  # the parts are fixed from here on
    counts = rows.groupBy("__ql_key", "__ql_part").agg(F.count("*").alias("__ql_n"))
    run = Window.partitionBy("__ql_key").orderBy("__ql_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__ql_before", F.coalesce(F.sum("__ql_n").over(run), F.lit(0))).drop("__ql_n")
    number = F.col("__ql_before") + F.row_number().over(Window.partitionBy("__ql_key", "__ql_part").orderBy("__ql_row")) - 1
    rows = rows.join(counts, ["__ql_key", "__ql_part"]).withColumn("__ql_page", F.floor(number / per))
    size = F.least(per, F.col("__ql_shard_n") - F.col("__ql_page") * per) * F.col("n_bytes")
    return rows.withColumns({"shard": F.concat(shard, F.lit("+"), F.col("__ql_page")), "shard_bytes": size}).drop("__ql_part", "__ql_row", "__ql_before", "__ql_page")


def write_shards(df: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """df as Parquet, a folder for each shard."""
    shards(df, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
l AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
s AS (SELECT depth, key >> CAST(60 - depth AS INTEGER) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, min(key) = max(key) AS single FROM l GROUP BY ALL),
f AS (SELECT l.doc_id, l.n_bytes, l.key, min(l.depth) AS depth FROM l JOIN s ON s.depth = l.depth AND s.prefix = (l.key >> CAST(60 - l.depth AS INTEGER))
      WHERE shard_bytes <= {SHARD_BYTES} OR single GROUP BY l.doc_id, l.n_bytes, l.key)
SELECT doc_id, f.depth || '-' || s.prefix AS shard, CAST(f.depth AS INTEGER) AS shard_depth, n_bytes, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversized
FROM f JOIN s ON s.depth = f.depth AND s.prefix = (f.key >> CAST(60 - f.depth AS INTEGER))
"""
