"""Expressions: published hash values, clock relations, parsers."""

from pyspark.sql import functions as F

from quorumlens.functions import clocks, hashes, scalars
from quorumlens.operators import chaos, placement

ADDRESS = "{}.kv.kvstore.svc.cluster.local:7000"
ZONES = {"kv-0": "b", "kv-1": "c", "kv-2": "d", "kv-3": "d", "kv-4": "c", "kv-5": "b"}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_fnv_of_ascii_other_letters_and_nothing(spark):
    words = ["", "a", "kv-0-17", "é中🙂", "x" * 300, "a\nb\0c"]
    rows = spark.createDataFrame([(w,) for w in words], "k string").select("k", hashes.fnv1a32(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {w: hashes.fnv1a32_py(w) for w in words}
    assert hashes.fnv1a32_py("a") == 0xE40C292C  # a published vector


def test_fingerprint_of_the_published_topology(spark):
    members = F.create_map(*[F.lit(x) for m in ZONES for x in (m, ADDRESS.format(m))])
    assert one(spark, f=hashes.fingerprint(members, F.lit(3)))["f"] == "163086ed37c3f78838b68b4d2a8cca84db11a1dafb396faf5c643cbe2a94e38a"


def test_clock_relations(spark):
    m = lambda d: F.from_json(F.lit(d), "map<string,bigint>")
    told = one(
        spark, equal=clocks.relation(m('{"a":1,"b":0}'), m('{"a":1}')), before=clocks.relation(m('{"a":1}'), m('{"a":1,"b":2}')),
        after=clocks.relation(m('{"a":2}'), m("{}")), concurrent=clocks.relation(m('{"a":1}'), m('{"b":1}')),
    )
    assert all(k == v for k, v in told.items())


def test_next_clock_and_union(spark):
    m = lambda d: F.from_json(F.lit(d), "map<string,bigint>")
    got = one(spark, n=clocks.next_clock(m('{"a":1}'), F.lit("b")), u=clocks.union(F.array(m('{"a":1,"z":0}'), m('{"a":3,"b":2}'))))
    assert got == {"n": {"a": 1, "b": 1}, "u": {"a": 3, "b": 2}}


def test_durations(spark):
    words = {"1.5s": 1_500_000_000, "15m0s": 900_000_000_000, "500ms": 500_000_000, "1h2m3s": 3_723_000_000_000, "-1s": -1_000_000_000, "0": 0, "soon": None}
    rows = spark.createDataFrame([(w,) for w in words], "d string").select("d", scalars.duration_ns(F.col("d")).alias("n")).collect()
    assert {r.d: r.n for r in rows} == words
    assert scalars.duration_ns_py("1.5s") == 1_500_000_000


def test_small_scalars(spark):
    got = one(
        spark, tier=scalars.size_tier(F.lit(10000)), cpu=scalars.millicores(F.lit("250m")), cpus=scalars.millicores(F.lit("0.5")),
        name=scalars.key_name(F.lit("chaos-pre"), F.lit(42)), value=scalars.synthetic_value(F.lit("k"), 5), long=scalars.synthetic_value(F.lit("key"), 2),
        match=scalars.value_matches(F.lit("k|xx"), F.lit("k")), target=scalars.hint_target(scalars.hint_key(F.lit("kv-1"), F.lit("a\0b"))),
        key=scalars.hint_item_key(scalars.hint_key(F.lit("kv-1"), F.lit("a\0b"))), text=scalars.json_value(F.lit('"a\\"b"')), number=scalars.json_value(F.lit("1.5")),
        cut=F.octet_length(scalars.short_message(F.lit("é" * 200))), ordinal=scalars.ordinal(F.lit("kv-12")),
    )
    assert got == {"tier": 2, "cpu": 250.0, "cpus": 500.0, "name": "chaos-pre-0000042", "value": "k|xxx", "long": "key|", "match": True, "target": "kv-1", "key": "a\0b", "text": 'a"b', "number": "1.5", "cut": 160, "ordinal": 12}


def test_published_shares_and_zone_losses(spark):
    """5000 keys on six members: the shares and failing keys that were published for this ring."""
    t = chaos.Topology({"kv-0": "b", "kv-1": "c", "kv-2": "d", "kv-3": "d", "kv-4": "c", "kv-5": "b"})
    keys = spark.range(5000).select(scalars.key_name(F.lit("chaos-pre"), F.col("id")).alias("key"))
    placed = placement.owners_of(keys, t.pods, t.n)
    shares = {r.pod: round(100 * r.share, 1) for r in placement.shares(placed, t.pods).collect()}
    assert shares == {"kv-0": 66.4, "kv-1": 37.7, "kv-2": 50.4, "kv-3": 47.2, "kv-4": 51.6, "kv-5": 46.8}
    found = {(r.fault, r.side): r.fails for r in chaos.summary(placed, chaos.faults_frame(spark, t), t).filter("op = 'put'").collect()}
    for pods, live, group in (("kv-0,kv-5", 1134, 3866), ("kv-1,kv-4", 1419, 3581), ("kv-2,kv-3", 868, 4132)):
        assert found[f"down:{pods}", "live"] == live and found[f"partition:{pods}", "group"] == group
        assert found[f"partition:{pods}", "rest"] == live and found[f"partition:{pods}", "nowhere"] == 0
    assert all(found[f"down:{p}", "live"] == 0 for p in t.pods)


def test_published_pins(spark):
    t = chaos.Topology(ZONES)
    keys = spark.range(20000).select(F.format_string("bench-pre-%06d", "id").alias("key"))
    placed = placement.owners_of(keys, t.pods, t.n)
    faults = chaos.faults_frame(spark, t, [("down", ["kv-0", "kv-2"]), ("down", ["kv-0", "kv-1"])])
    found = {r.fault: r.fails for r in chaos.summary(placed, faults, t).filter("op = 'put' and side = 'live'").collect()}
    assert found == {"down:kv-0,kv-2": 9044, "down:kv-0,kv-1": 1336}
    shares = {r.pod: round(r.share, 3) for r in placement.shares(placed, t.pods).collect()}
    assert (shares["kv-0"], shares["kv-1"]) == (0.71, 0.338)
