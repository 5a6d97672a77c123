"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key of 60 bits. Sizes are summed by source and key range (the top
12 bits), the sums are carried on from range to range, and the one range in which a source's budget
ends is cut into ranges by the next bits while it has many rows, then sorted by key and summed document
by document: that gives the source's cut. A document
before the cut is taken in the last, partial epoch, the one at the cut as far as the budget goes,
and every document once in each full epoch. Only the cuts, a row for each source, are joined back.

Defined results: a null or wordless text has size 0, and one of any length counts whole; a null source is a source of its own, the last;
rows equal in id and text that stand at a cut share what is left evenly, each rounded down; an empty
table gives an empty table; columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlens.llm.common import WORD, forget, materialise, quoted, table

RANGE_BITS, KEY_BITS = 12, 60
#: A range of more rows than this is cut into ranges again before it is sorted.
RANGE_ROWS = 1_000_000
#: Sources up to which their cuts are broadcast (some 80 bytes each).
FEW_SOURCES = 20_000


def random_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with target and whole epochs: weighted shares, none above most times its size.

    One row for each source in one task. Resharing the excess of full sources until none is above its limit
    comes to one level per weight; sources in order of limit by weight are full up to the first that isn't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.row_number().over(by_name) - 1) % len(weights))]
    df = sizes.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(most)), "rank": F.row_number().over(by_name)})
    df = df.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("full", F.col("ratio") <= F.col("level"))
    df = df.withColumn("first", F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "level"))).over(every))
    df = df.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("first.level") * F.col("weight")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    return df.select("source", "source_size", "target", "epochs", "rest")


def ended(ranges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of ranges (source, part, size, n), that in which each source's budget (rest) ends, with what of it is left there."""
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    ends = ranges.alias("a").join(budgets.alias("b"), F.expr("a.source <=> b.source and a.before <= b.rest and b.rest < a.before + a.size"))
    return ends.select("a.source", "a.part", "a.n", (F.col("rest") - F.col("before")).alias("rest"))


def cuts(narrow: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_left, cut_copies) of narrow (source, key, size)."""
    part = lambda bits: F.shiftright("key", KEY_BITS - bits).alias("part")
    summed = lambda df, bits: df.groupBy("source", part(bits)).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    bits = RANGE_BITS
    ranges = materialise(summed(narrow, bits), "ranges")
    wanted = materialise(targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    ends, there = materialise(ended(ranges, wanted), "ends"), narrow
    steps = [ranges, wanted, ends]
    while True:
        there = there.withColumn("part", part(bits)).drop("rest").alias("a").join(ends.alias("b"), F.expr("a.source <=> b.source and a.part = b.part"))
        there = there.select("a.source", "key", "a.size", "rest")
        if bits >= KEY_BITS or (ends.agg(F.max("n")).first()[0] or 0) <= RANGE_ROWS:
            break
        bits, there = bits + RANGE_BITS, materialise(there, "open-range")
        steps += [there, ends := materialise(ended(summed(there, bits), ends), "ends")]
    keys = there.groupBy("source", "key", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).filter("before <= rest and rest < before + size")
    keys = keys.select("source", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_left"), F.col("copies").alias("cut_copies"))
    out = materialise(wanted.alias("a").join(keys.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.*", "cut_key", "cut_left", "cut_copies").drop("rest"), "cuts")
    forget(*steps)
    return out


def with_size(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    body = F.col(quoted(text))
    return df.withColumns({"__ql_source": F.col(quoted(source)), "__ql_key": random_key(F.col(quoted(doc_id)), body), "__ql_size": F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long")})


def with_cut(df: DataFrame, cut: DataFrame) -> DataFrame:
    """df with its source's cut; the cuts are broadcast if they are few."""
    cut = cut.withColumnsRenamed({c: f"__ql_{c}" for c in cut.columns if c != "source"}).withColumnRenamed("source", "__ql_cut_source")
    few = cut.count() <= FEW_SOURCES
    return df.join(F.broadcast(cut) if few else cut, F.expr("__ql_source <=> __ql_cut_source"), "left").drop("__ql_cut_source")


PARTIAL = "case when __ql_key = __ql_cut_key then cast(floor(__ql_cut_left / __ql_cut_copies) as bigint) else 0L end"
FULL = "__ql_epochs + case when __ql_key < __ql_cut_key then 1L else 0L end"


def mix_counts(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For each row: its id, size, source_size, target and taken, the words that the mix takes of it."""
    narrow = materialise(with_size(df, doc_id, text, source).select(F.col(quoted(doc_id)).alias("doc_id"), "__ql_source", "__ql_key", "__ql_size"), "sizes")
    cut = cuts(narrow.select(F.col("__ql_source").alias("source"), F.col("__ql_key").alias("key"), F.col("__ql_size").alias("size")), weights, share, most)
    return with_cut(narrow, cut).select("doc_id", F.col("__ql_size").alias("size"), F.col("__ql_source_size").alias("source_size"), F.col("__ql_target").alias("target"), F.expr(f"({FULL}) * __ql_size + {PARTIAL}").alias("taken"))


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus itself: a row of df for each epoch that takes it, the text at a cut shortened to the words taken."""
    sized = with_size(df, doc_id, text, source)
    narrow = materialise(sized.select(F.col("__ql_source").alias("source"), F.col("__ql_key").alias("key"), F.col("__ql_size").alias("size")), "sizes")
    cut = cuts(narrow, weights, share, most)
    forget(narrow)
    out = with_cut(sized, cut).withColumns({"__ql_full": F.expr(FULL), "__ql_words": F.expr(PARTIAL)})
    out = out.withColumn("__ql_turns", F.col("__ql_full") + F.when(F.col("__ql_words") > 0, 1).otherwise(0)).filter("__ql_turns > 0")
    out = out.withColumn("__ql_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__ql_turns"))))
    body = F.col(quoted(text))
    begun = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__ql_words").cast("int")), "")
    out = out.withColumn(text, F.when(F.col("__ql_turn") <= F.col("__ql_full"), body).otherwise(begun))
    return out.select(*[F.col(quoted(c)) for c in df.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


KEYED = r"""
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents)"""

ORACLE = f"""
WITH {KEYED},
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, lim / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN lim ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
k AS (SELECT source, key, sum(size) AS size, count(*) AS copies FROM d GROUP BY source, key),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) - size AS before FROM k)
SELECT doc_id, d.size, source_size, target,
       CAST(epochs * d.size + CASE WHEN floor(target) - epochs * source_size >= p.before + p.size THEN d.size
                                   ELSE greatest(0, (CAST(floor(target) AS BIGINT) - epochs * source_size - p.before) // p.copies) END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.key = d.key
"""
