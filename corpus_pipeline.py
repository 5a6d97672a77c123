"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Language identification rejects documents without a language of their own, near-duplicates keep one
document of each group, decontamination drops what the benchmark contaminates, mixing repeats or cuts
each source to its target, and sharding, the last, adds each document's shard. All but the last return
the columns of documents. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import contamination, language, mixing, sharding, simhash
from quorumlens.llm.common import forget, materialise, table

#: The mean probability of its words' language that a document needs.
LEAST_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words mostly have one learned language; its label replaces a null lang and no other."""
    kept = tuple(docs.columns)
    found = language.languages(docs, F.lit(True), keep=kept, names=("__ql_lang", "__ql_score"))
    found = found.filter((F.col("__ql_lang") != language.UNKNOWN) & (F.col("__ql_score") >= LEAST_LANGUAGE))
    return found.withColumn("lang", F.coalesce("lang", "__ql_lang")).select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination; they are named by id and text, so repeated ids are told apart."""
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = materialise(found.filter("contaminated").select(F.col("doc_id").alias("__ql_id"), F.col("text_md5").alias("__ql_md5")).distinct(), "contaminated")
    marked = docs.withColumn("__ql_own", F.md5("text"))
    return marked.join(bad, F.expr("doc_id <=> __ql_id and __ql_own <=> __ql_md5"), "left_anti").drop("__ql_own")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A conditional random field is no SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
            if before is not None:
                forget(before)  # the next stage reads this one's table
            before = docs
    return docs
