"""The checker on a dozen literal requests that fall into every bucket, and its report."""

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import chaos, placement
from quorumlens.sources import logs, sinks

T = chaos.Topology({"kv-0": "a", "kv-1": "b", "kv-2": "a", "kv-3": "b", "kv-4": "c", "kv-5": "c"})
S = chaos.SECOND
BASE = 1_700_000_000 * S
REQUEST = "test string, seq long, op string, key string, target string, start long, `end` long, result string"


def keys_with(spark, n, inside):
    """n keys with so many owners among kv-0 and kv-2."""
    told = placement.owners_of(spark.range(400).select(F.concat(F.lit("key-"), "id").alias("key")), T.pods, 3)
    hit = F.size(F.array_intersect("owners", F.lit(["kv-0", "kv-2"]))) == inside
    return [(r.key, r.owners) for r in told.filter(hit).orderBy("key").limit(n).collect()]


@pytest.fixture(scope="module")
def case(spark):
    two, one, none = keys_with(spark, 2, 2), keys_with(spark, 4, 1), keys_with(spark, 3, 0)
    read = none[2][0]
    rows = [
        ("pre", "put", read, "kv-1", -100, "ok"), ("t1", "put", none[0][0], "kv-1", -10, "ok"), ("t1", "put", two[0][0], "kv-1", 20, "failed"),
        ("t1", "put", two[1][0], "kv-1", 21, "ok"), ("t1", "put", one[0][0], "kv-1", 22, "ok"), ("t1", "put", none[1][0], "kv-0", 23, "unknown"),
        ("t1", "put", one[1][0], "kv-1", 24, "failed"), ("t1", "put", one[2][0], "kv-1", 1, "ok"), ("t1", "get", read, "kv-3", 25, "notfound"),
        ("t1", "put", one[3][0], "svc-2", 26, "unknown"), ("t1", "put", "key-x", "kv-1", 27, "dropped"), ("t1", "put", none[0][0] + "-after", "kv-1", 90, "ok"),
    ]
    requests = spark.createDataFrame([(t, i, op, k, to, BASE + at * S, BASE + at * S + S // 100, r) for i, (t, op, k, to, at, r) in enumerate(rows)], REQUEST)
    back = [(read, "ok", 0, 0), (none[0][0], "ok", 3, 3), (two[1][0], "notfound", 0, 0), (one[0][0], "ok", 3, 2), (one[2][0], "ok", 3, 2), (one[1][0], "notfound", 0, 0), (none[0][0] + "-after", "ok", 0, 0)]
    readback = spark.createDataFrame([(k, 0, i, r, o, h) for i, (k, r, o, h) in enumerate(back)], "key string, time_ns long, pass int, result string, n_owners int, n_holders int")
    events = spark.createDataFrame([("t1", "inject", "zone:a", None, BASE), ("t1", "heal", None, None, BASE + 60 * S)], "test string, event string, fault string, mark string, time_ns long")
    lines = chaos.timelines(events, T, S)
    return requests, readback, lines, chaos.judged(requests, lines, T), two, one


def test_buckets_and_hints(case):
    *_, rows, _, _ = case
    got = {r.bucket: r.n for r in chaos.bucket_counts(rows).filter("test = 't1'").collect()}
    assert got == {"as-predicted": 5, "unexpected-success": 1, "unexpected-failure": 1, "stale-read": 1, "service-failure": 1, "transition": 1, "dropped": 1}
    h = chaos.hint_totals(rows).filter("test = 't1'").first()
    assert (h.hints, h.hints_maybe, h.under_replicated) == (3, 1, 1)


def test_readback_and_verdict(case):
    requests, readback, lines, rows, two, one = case
    rep = chaos.readback_report(requests, readback, rows.filter("expected_under"))
    r = rep.first()
    assert (r.acked, r.lost, r.not_read_back, r.unacked_absent) == (6, 1, 0, 1)
    assert (r.under_replicated, r.under_replicated_expected, r.under_replicated_unexpected) == (2, 1, 1)
    assert [k.key for k in chaos.listed(requests, readback).collect()] == [two[1][0]]
    assert not chaos.verdict(rows, rep).first().ok
    text = sinks.report_text(rows, lines, rep, chaos.listed(requests, readback))
    for part in ("== test t1: zone:a", f"LOST {two[1][0]}", "!unexpected-success=1", "== FAIL"):
        assert part in text


def test_members_back_one_by_one(spark):
    events = [("t", "inject", "down:kv-0,kv-2", None, 0), ("t", "mark", None, "serving-kv-2", 100 * S), ("t", "heal", None, None, 200 * S)]
    lines = chaos.timelines(spark.createDataFrame(events, "test string, event string, fault string, mark string, time_ns long"), T, S)
    at = spark.createDataFrame([("t", i, "put", "k", "kv-1", s * S, s * S + 1, "ok") for i, s in enumerate((50, 99, 150, 300))], REQUEST)
    got = {r.seq: (r.phase, r.now_pods) for r in chaos.phased(at, lines).collect()}
    assert got == {0: ("fault", ["kv-0", "kv-2"]), 1: ("transition", ["kv-0", "kv-2"]), 2: ("fault", ["kv-0"]), 3: ("normal", ["kv-0"])}


def test_timeline_errors(spark):
    events = [("a", "inject", "none", None, 5), ("a", "inject", "none", None, 6), ("b", "heal", None, None, 1), ("c", "inject", "none", None, 5), ("c", "heal", None, None, 1), ("d", "inject", "none", None, 1), ("d", "mark", None, "", 2), ("d", "odd", None, None, 3)]
    got = {(r.test, r.error) for r in chaos.timeline_errors(spark.createDataFrame(events, "test string, event string, fault string, mark string, time_ns long")).collect()}
    assert got == {("a", "injected twice"), ("b", "never injected"), ("c", "healed before it was injected"), ("d", "a mark without a name"), ("d", "unknown event")}


def test_fault_specs():
    assert chaos.parse_fault("zone:a", T) == ("down", ["kv-0", "kv-2"])
    assert chaos.parse_fault("partition-zone:c", T) == ("partition", ["kv-4", "kv-5"])
    assert chaos.parse_fault("down:kv-3,kv-1,kv-3", T) == ("down", ["kv-1", "kv-3"])
    for bad in ("zone:x", "down:", "down:kv-9", "partition:" + ",".join(T.pods), "other:kv-1"):
        with pytest.raises(ValueError):
            chaos.parse_fault(bad, T)


def test_readers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"test":"t","seq":1,"op":"put","key":"k","start":1,"end":2,"result":"ok"}\n\n')
    assert logs.requests(spark, str(tmp_path / "r.jsonl")).select("test", "end").collect() == [("t", 2)]
    (tmp_path / "e.jsonl").write_text('{"time":"2024-01-10T00:00:00.147Z","test":"t0","event":"heal"}\n')
    assert logs.events(spark, str(tmp_path / "e.jsonl")).first().time_ns == 1704844800147000000
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.requests(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "m.txt").write_text("ADD a\nADD b\nREMOVE a\nADD c d\nADD torn")
    from quorumlens.operators.layers import live_files

    assert sorted(r.id for r in live_files(logs.manifest(spark, str(tmp_path / "m.txt"))).collect()) == ["b", "c", "d"]
    assert logs.keys(spark, "p:3").collect() == [("p-0000000",), ("p-0000001",), ("p-0000002",)]


def test_log_stops_at_a_torn_record(spark, tmp_path):
    import json
    import zlib

    from quorumlens.operators import versions

    def frame(**e):
        body = json.dumps(e).encode()
        return len(body).to_bytes(4, "big") + zlib.crc32(body).to_bytes(4, "big") + body

    v = lambda x, c: {"Value": x, "VectorClock": c, "LastUpdatedBy": "a", "IsDeleted": False}
    (tmp_path / "wal.log").write_bytes(frame(Key="k", **v("1", {"a": 1})) + frame(Key="k", **v("2", {"b": 1})))
    (tmp_path / f"wal_{1:020d}.log").write_bytes(frame(Key="k", Op=1, Items=[v("3", {"c": 1})]) + frame(Key="j", **v("4", {"a": 1})) + frame(Key="j", **v("5", {"a": 2}))[:-1])
    (tmp_path / f"wal_{2:020d}.log").write_bytes(b"")
    entries = logs.log_entries(logs.log_segments(spark, str(tmp_path)))
    assert entries.count() == 4
    log = logs.log_versions(entries)
    got = {(r.key, r.value_json) for r in versions.replay(log).collect()}
    assert got == {("k", "3"), ("j", "4")}


def test_layer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, {"a": 1}), ("a", 2, {"a": 1}), ("a", 3, {"b": 1})], "key string, seq long, clock map<string,bigint>")
    sinks.write_layer(df, str(tmp_path / "layer"))
    assert sorted(spark.read.parquet(str(tmp_path / "layer")).select("key", "seq").collect()) == [("a", 2), ("a", 3), ("b", 1)]
    sinks.write_text(str(tmp_path / "x"), "hi")
    assert (tmp_path / "x").read_text() == "hi"


def test_a_segment_is_written_and_read_bit_by_bit(spark, tmp_path, monkeypatch):
    """No column holds a whole segment, and no task gathers one: a segment may be larger than an executor."""
    from quorumlens.sources import logs as reader

    monkeypatch.setattr(reader, "HELD", 1000, raising=False)
    path = f"file://{tmp_path}/log"
    rows = spark.range(30000).selectExpr("id % 3 + 1 as segment", "30000 - id as seq", "concat('{\"Key\":\"é', id, '\",\"Value\":\"1\",\"VectorClock\":{\"a\":', id + 1, '},\"LastUpdatedBy\":\"a\",\"IsDeleted\":false}') as json")
    written = sinks.append_log(rows, path)
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Sort" in plan
    assert sorted(map(tuple, written.collect())) == [(1, 10000), (2, 10000), (3, 10000)]
    segments = reader.log_segments(spark, path)
    assert segments.filter("content is not null").count() == 0
    entries = reader.log_entries(segments)
    got = sorted((r.segment, r.place, r.Key) for r in entries.collect())
    want = [(s, n, f"é{i}") for s in (1, 2, 3) for n, i in enumerate(sorted((i for i in range(30000) if i % 3 + 1 == s), reverse=True))]
    assert got == want
