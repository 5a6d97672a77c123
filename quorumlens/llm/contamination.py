"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each window of 13 words keeps the smallest of its nine 5-word hashes as its fingerprint, so any 13 words
that a document and a benchmark item share have the fingerprint in common. Documents' fingerprints are
joined with the items'; each one in common is extended to the 13 words of its window, which count if
they are a window of an item, and successive windows make longer runs. An item of fewer than 13 words
is one window, found by the hash of all its words. What is joined has a few numbers for each row: only
windows in which a fingerprint was found leave the scan, whatever the length of a text.

Words are compared by their 64-bit hashes. Defined results: a null or wordless text has no words and no
hits; an item without words is never found; items with the same item_id count once, a null item_id is
written as the empty string; repeated document rows give repeated result rows; a text of any length is
taken whole; an empty benchmark leaves every document clean; other columns aren't passed on, so their
names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlens.llm.common import ascii_lower, forget, materialise, quoted, table

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lowered.
ANY_CASE_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
#: Hashes of items that are broadcast (8 bytes each); a larger benchmark is joined by shuffles.
FEW_HASHES = 1_000_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def n_words(text: Column) -> Column:
    """The number of a text's words; only the first and the last part between breaks can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), ANY_CASE_BREAKS)
    empty = lambda c: F.when(c == "", 1).otherwise(0)
    return F.greatest(F.lit(0), F.size(parts) - empty(parts[0]) - empty(F.element_at(parts, -1))).cast("long")


def hashed(df: DataFrame) -> DataFrame:
    """df with w, the hashes of its text's words, and n, their number, instead of the text."""
    return df.withColumn("w", word_hashes(F.col("text"))).drop("text").withColumn("n", F.size("w"))


def at_each_place(span: int, f) -> Column:
    """f of each place at which span of the n words fit, else null."""
    return F.when(F.col("n") >= span, F.transform(F.sequence(F.lit(0), F.col("n") - span), f))


def with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("grams", at_each_place(GRAM, lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(GRAM)])))


def fingerprint(span: int, i: Column) -> Column:
    """Of the window at place i: the smallest of its grams' hashes; of a short item, which is one window, the hash of all its words."""
    if span < WINDOW:
        return F.xxhash64(F.lit(span), *[F.col("w")[i + j] for j in range(span)])
    return F.least(*[F.col("grams")[i + j] for j in range(WINDOW - GRAM + 1)])


def prints(span: int) -> Column:
    return at_each_place(span, lambda i: fingerprint(span, i))


def whole(span: int, i: Column) -> Column:
    """The hash of all words of the window at place i; three grams, which overlap by a word, hold thirteen."""
    return fingerprint(span, i) if span < WINDOW else F.xxhash64(*[F.col("grams")[i + j] for j in range(0, WINDOW - GRAM + 1, GRAM - 1)])


def exploded(df: DataFrame, arrays: list[Column], name: str) -> DataFrame:
    """df with a row instead of its words for each element of the arrays; such rows are small, so a text of n words costs n small rows."""
    rest = [c for c in df.columns if c not in ("w", "grams")]
    for i, a in enumerate(arrays):
        df = df.withColumn(f"array{i}", F.coalesce(a, F.array().cast(df.select(a).schema[0].dataType)))
    all_ = F.concat(*[F.col(f"array{i}") for i in range(len(arrays))]) if len(arrays) > 1 else F.col("array0")
    # outer, as else the optimiser would first evaluate the whole array for a filter on its size
    return df.select(*rest, F.explode_outer(all_).alias(name))


def windows(df: DataFrame, spans: list[int]) -> DataFrame:
    """df (w: word hashes, n: their number, ...) with a row for each window: place, span, fingerprint h, and win, the hash of all its words."""
    entry = lambda span: at_each_place(span, lambda i: F.struct(i.alias("place"), F.lit(span).alias("span"), fingerprint(span, i).alias("h"), whole(span, i).alias("win")))
    df = exploded(with_grams(df), [entry(span) for span in spans], "e")
    return df.select(*[c for c in df.columns if c != "e"], "e.*")


def item_windows(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, list[int]]:
    """(win, h, item) of every window of every item; the spans that there are."""
    items = benchmark.select(F.coalesce(F.col(quoted(item)).cast("string"), F.lit("")).alias("item"), F.col(quoted(text)).alias("text"))
    items = materialise(hashed(items).filter("n > 0"), "items")
    spans = sorted({min(WINDOW, r["n"]) for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()})  # 13 at most
    if not spans:
        return items.select(F.lit(0).cast("long").alias("win"), F.lit(0).cast("long").alias("h"), "item").limit(0), spans
    found = windows(items, spans).filter("span = least(n, 13)")
    out = materialise(found.select("win", "h", "item").distinct(), "item-windows")
    forget(items)
    return out, spans


def bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= FEW_HASHES else keys


def occurrences(docs: DataFrame, items: DataFrame, spans: list[int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_md5, place, span, win) of the windows of docs that are windows of items; a written table."""
    body = F.col(quoted(text))
    rows = docs.filter(body.isNotNull()).select(F.col(quoted(doc_id)).alias("doc_id"), F.md5(body).alias("text_md5"), body.alias("text"))
    tables = [materialise(items.select(c).distinct(), c) for c in ("h", "win")]
    fingerprints, wins = map(bounded, tables)
    # first the documents with any fingerprint in common, then the windows of those alone
    every = exploded(with_grams(hashed(rows)), [prints(span) for span in spans], "h")
    met = materialise(every.join(fingerprints, "h", "left_semi").select("doc_id", "text_md5").distinct(), "met")
    if met.count() <= FEW_HASHES:  # else every document's windows are looked at, which costs less than moving the texts
        rows = rows.alias("a").join(F.broadcast(met).alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_md5 = b.text_md5"), "left_semi")
    found = windows(hashed(rows), spans).join(fingerprints, "h", "left_semi").join(wins, "win", "left_semi")
    out = materialise(found.select("doc_id", "text_md5", "place", "span", "win").distinct(), "occurrences")
    forget(*tables, met)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, text_md5, n_words, n_hit, n_items, items_sha256, contaminated."""
    items, spans = item_windows(benchmark, item, item_text)
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.md5(F.col(quoted(text))).alias("text_md5"), n_words(F.col(quoted(text))).alias("n_words"))
    nothing = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    if not spans:
        return rows.withColumns(nothing).withColumn("contaminated", F.lit(False))
    met = occurrences(docs, items, spans, doc_id, text)
    # words in the union of a document's windows, one after another by place
    run = Window.partitionBy("doc_id", "text_md5").orderBy("place", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("place") + F.col("span")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("place"), F.coalesce(F.max(end).over(run), F.lit(0))))
    hits = met.withColumn("new", new).groupBy("doc_id", "text_md5").agg(F.sum("new").cast("long").alias("n_hit"))
    # an item's name once for each document
    named = met.select("doc_id", "text_md5", "win").distinct().join(items.select("win", "item").distinct(), "win").select("doc_id", "text_md5", "item").distinct()
    names = named.groupBy("doc_id", "text_md5").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    same = "a.doc_id <=> b.doc_id and a.text_md5 = b.text_md5"
    found = hits.alias("a").join(names.alias("b"), F.expr(same)).select("a.*", "b.n_items", "b.items_sha256")
    found = materialise(found, "contamination")
    forget(items, met)
    out = rows.alias("a").join(found.alias("b"), F.expr(same), "left").select("a.*", *[F.coalesce(F.col(f"b.{c}"), zero).alias(c) for c, zero in nothing.items()])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT rid, size, s, array_to_string(w[s:s + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT rid, s, dw.size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM h) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS found FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
