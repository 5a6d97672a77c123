"""Surviving versions: the set form, the fold, restores, puts."""

import random

from pyspark.sql import functions as F

from quorumlens.operators import versions

SCHEMA = "key string, seq long, value_json string, clock map<string,bigint>, is_deleted boolean"


def covers(a, b):
    return all(a.get(k, 0) >= v for k, v in b.items())


def fold(rows):
    """Arrival order, one key: what resolving one by one leaves."""
    kept = []
    for r in rows:
        c = {k: v for k, v in r[3].items() if v}
        if not any(covers(k[3], c) for k in kept):
            kept = [k for k in kept if not covers(c, k[3])] + [(*r[:3], c, *r[4:])]
    return {r[1] for r in kept}


def random_rows(n, keys, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", i, f'"v{i}"', {m: rng.randrange(4) for m in rng.sample("abcd", rng.randrange(5))}, rng.random() < 0.2) for i in range(n)]


def test_set_form_is_the_fold(spark):
    rows = random_rows(600, 12, 1)
    got = {(r.key, r.seq) for r in versions.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(k, s) for k in {r[0] for r in rows} for s in fold([r for r in rows if r[0] == k])}
    assert got == want


def test_a_key_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(versions, "PIECE", 8)
    rows = [("hot", i, "1", {"a": i % 40, "b": (i * 7) % 41, "c": (i * 3) % 23}, False) for i in range(400)]
    got = {r.seq for r in versions.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == fold(rows)


def test_the_fold_takes_every_version(spark, monkeypatch):
    monkeypatch.setattr(versions, "PIECE", 8)
    rows = random_rows(400, 9, 2) + [("hot", i, "1", {"a": i % 40, "b": (i * 7) % 41, "c": (i * 3) % 23}, False) for i in range(400)]
    got = {(r.key, r.seq) for r in versions.folded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(k, s) for k in {r[0] for r in rows} for s in fold([r for r in rows if r[0] == k])}
    assert any(s % 4 for _, s in got) and versions.folded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_does_not_matter_but_for_ties(spark):
    rows = random_rows(200, 5, 3)
    shuffled = random.Random(4).sample(rows, len(rows))
    a, b = (versions.survivors(spark.createDataFrame(r, SCHEMA)) for r in (rows, shuffled))
    assert {r.seq for r in a.collect()} == {r.seq for r in b.collect()}
    again = versions.survivors(versions.survivors(spark.createDataFrame(rows, SCHEMA)))
    assert {r.seq for r in again.collect()} == {r.seq for r in a.collect()}


def test_empty_and_equal_clocks(spark):
    rows = [("k", 1, "1", {}, False), ("k", 2, "2", {"a": 0}, False), ("j", 3, "3", {"a": 1}, False), ("j", 4, "4", {"a": 1}, True)]
    assert sorted(r.seq for r in versions.survivors(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]
    assert versions.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_siblings_as_arrays(spark):
    rows = [("k", [{"clock": {"a": 1}}, {"clock": {"b": 1}}], [{"clock": {"a": 1}}, {"clock": {"a": 2, "b": 1}}, {"clock": {"c": 1}}])]
    df = spark.createDataFrame(rows, "key string, a array<struct<clock:map<string,bigint>>>, b array<struct<clock:map<string,bigint>>>")
    got = df.select(versions.merge_siblings(F.col("a"), F.col("b")).alias("m")).first().m
    assert [x.clock for x in got] == [{"a": 2, "b": 1}, {"c": 1}]


def test_puts(spark):
    have = spark.createDataFrame([("k", 1, "1", {"a": 1}, False), ("k", 2, "2", {"b": 1}, False)], SCHEMA)
    writes = [("k", '"x"', None, "a#1", False), ("k", '"y"', {}, "a#1", False), ("new", '"z"', None, "a#1", False), ("none", None, None, "a#1", True)]
    out = {(r.key, r.value_json): r.clock for r in versions.put(have, spark.createDataFrame(writes, "key string, value_json string, context map<string,bigint>, node string, is_deleted boolean")).collect()}
    assert out == {("k", '"x"'): {"a": 1, "b": 1, "a#1": 1}, ("k", '"y"'): {"a#1": 1}, ("new", '"z"'): {"a#1": 1}}


def test_live_values_and_context(spark):
    rows = [("k", 1, '"a"', {"a": 1}, False), ("k", 2, None, {"b": 2}, True), ("d", 3, None, {"c": 1}, True)]
    got = {r.key: (r["values"], r.found, r.context) for r in versions.live(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"k": (['"a"'], True, {"a": 1, "b": 2}), "d": ([], False, {"c": 1})}


def test_restore_replaces(spark):
    rows = [("k", 1, "1", {"a": 1}, False, False), ("k", 2, "2", {"b": 1}, False, True), ("k", 3, "3", {"c": 1}, False, False)]
    log = spark.createDataFrame(rows, SCHEMA + ", is_restore boolean")
    assert sorted(r.seq for r in versions.replay(log).collect()) == [2, 3]
