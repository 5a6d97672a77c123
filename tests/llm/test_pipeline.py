"""The pipeline's stages, each held against its operator on its own input, and odd documents through all."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import contamination, mixing, simhash
from quorumlens.llm.common import materialise, table

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, f in corpus_pipeline.STAGES:
        out[name] = docs, materialise(f(spark, docs, SF), name)
        docs = out[name][1]
    return out


def rows(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def test_columns(outputs):
    for name, (before, after) in outputs.items():
        assert after.columns[: len(before.columns)] == before.columns and (name == "sharding" or after.columns == before.columns)


def test_language_keeps_clean_documents(outputs):
    before, after = outputs["language"]
    assert after.count() >= 0.99 * before.filter("length(text) > 20").count()


def test_near_duplicates_keep_one_of_each(outputs):
    before, after = outputs["near_duplicates"]
    found = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in found}) and after.count() < before.count()


def test_decontamination_drops_what_the_rule_says(spark, outputs):
    before, after = outputs["decontamination"]
    bad = {r.doc_id for r in contamination.contamination(before, table(spark, SF, "benchmark")).collect() if r.contaminated}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_mixing_takes_its_words(outputs):
    before, after = outputs["mixing"]
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.split())
    assert {r.doc_id: r.taken for r in mixing.mix_counts(before).collect() if r.taken} == {d: n for d, n in words.items() if n}


def test_sharding_keeps_every_row(outputs):
    before, after = outputs["sharding"]
    assert rows(before, *before.columns) == rows(after, *before.columns)
    assert after.filter("shard_bytes > 2 * 1024 * 1024 and not oversized").count() == 0


def test_odd_documents_pass_through(spark):
    rng = random.Random(1)
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").limit(120).collect()]
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (5, real[3][1], None, None, None), (5, real[3][1], None, None, None), (None, real[7][1], "en", None, 1), (9, "?? !!", "de", "s", 5)]
    df = spark.createDataFrame(rng.sample(real + odd, len(real + odd)), "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1.0), "shard": F.lit("mine")})
    for name, f in corpus_pipeline.STAGES:
        df = materialise(f(spark, df, SF), name)
    assert 0 < df.count() and df.filter("text is null").count() == 0
    empty = table(spark, SF, "documents").limit(0)
    for name, f in corpus_pipeline.STAGES:
        empty = materialise(f(spark, empty, SF), name)
    assert empty.count() == 0


def test_run(spark, outputs):
    assert corpus_pipeline.run(spark, SF).count() == outputs["sharding"][1].count()
