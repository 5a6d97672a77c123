"""The query catalogue: each query over the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions import clocks, hashes, scalars
from quorumlens.operators import chaos, layers, membership, placement, reconcile, telemetry, versions
from quorumlens.plans.fixtures import fixture, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOPOLOGY = chaos.Topology({"kv-0": "b", "kv-1": "c", "kv-2": "d", "kv-3": "d", "kv-4": "c", "kv-5": "b"})
SEVEN = [*TOPOLOGY.pods, "kv-6"]
TOLERANCE = 2 * chaos.SECOND
COUNTERS = ["v0", "v1", "v2"]


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


def clocked(df: DataFrame) -> DataFrame:
    """Counter columns as a clock of three nodes."""
    return df.withColumn("clock", clocks.from_counters(**{f"kv-{i}": F.col(v) for i, v in enumerate(COUNTERS)}))


def bigint(df: DataFrame) -> DataFrame:
    """Counts and sizes as long, as the SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def w1(spark, sf) -> DataFrame:
    return clocked(fixture(spark, sf, "W1"))


def w2(spark, sf) -> DataFrame:
    return clocked(fixture(spark, sf, "W2"))


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Parts of the SQL

COVERED = "b.v0 >= a.v0 AND b.v1 >= a.v1 AND b.v2 >= a.v2"
MORE = "b.v0 + b.v1 + b.v2 > a.v0 + a.v1 + a.v2"


def maximal(name: str, source: str) -> str:
    return f"{name} AS (SELECT a.* FROM {source} a WHERE NOT EXISTS (SELECT 1 FROM {source} b WHERE b.key = a.key AND {COVERED} AND {MORE}))"


def deduped(name: str, source: str, order: str = "layer_rank, seq", where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, v0, v1, v2 ORDER BY {order}) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


def fnv(key: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({key}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def ring(name: str, members: list[str], n: int = 3) -> str:
    """name(pos, owners): the owners of hashes up to pos."""
    values = ", ".join(f"('{m}')" for m in members)
    return f"""{name}_r AS (SELECT pos, min(m) AS m FROM (SELECT m, {fnv("m || '-' || i")} AS pos FROM (VALUES {values}) AS v(m), range(150) AS r(i)) GROUP BY pos),
{name}_d AS (SELECT p.pos, q.m, min((q.pos - p.pos + 4294967296) % 4294967296) AS far FROM {name}_r p, {name}_r q GROUP BY p.pos, q.m),
{name} AS (SELECT pos, list(m ORDER BY far)[1:{n}] AS owners FROM {name}_d GROUP BY pos)"""


def placed(name: str, keys: str, ring_name: str, owners: str = "owners") -> str:
    """name: keys (key, h) with owners."""
    return f"{name} AS (SELECT k.*, coalesce(r.owners, (SELECT arg_min(owners, pos) FROM {ring_name})) AS {owners} FROM {keys} k ASOF LEFT JOIN {ring_name} r ON k.h <= r.pos)"


def keys(name: str, source: str, key: str, more: str = "") -> str:
    return f"{name} AS (SELECT {key} AS key, {fnv(key)} AS h{', ' + more if more else ''} FROM {source})"


ORDER_KEY = "concat('order-', o_orderkey)"
PODS = TOPOLOGY.pods


def order_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.lit("order-"), "o_orderkey").alias("key"))


def customer_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_name").alias("key"))


# Causal versioning


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) AS n, max(v0) AS v0, max(v1) AS v1, max(v2) AS v2 FROM s GROUP BY key")
def surviving_siblings(spark, sf):
    return versions.survivors(w1(spark, sf)).groupBy("key").agg(F.count("*").alias("n"), *[F.max(v).alias(v) for v in COUNTERS])


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT n, count(*) AS keys FROM (SELECT key, count(*) AS n FROM s GROUP BY key) GROUP BY n")
def sibling_histogram(spark, sf):
    return versions.survivors(w1(spark, sf)).groupBy("key").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) FILTER (WHERE NOT is_deleted) > 0 AS found, count(*) FILTER (WHERE NOT is_deleted) AS n, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (WHERE NOT is_deleted), '') AS seqs, max(v0) AS v0 FROM s GROUP BY key")
def live_values(spark, sf):
    resolved = versions.survivors(w1(spark, sf)).withColumn("value_json", F.col("seq").cast("string"))
    return versions.live(resolved).select("key", "found", F.size("values").cast("long").alias("n"), F.array_join("values", ",").alias("seqs"), F.coalesce(F.col("context")["kv-0"], F.lit(0)).alias("v0"))


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, max(v0) + 1 AS v0, max(v1) AS v1, max(v2) AS v2 FROM s GROUP BY key")
def next_context(spark, sf):
    known = versions.context(versions.survivors(w1(spark, sf)))
    after = clocks.next_clock(F.col("context"), F.lit("kv-0"))
    return known.select("key", *[F.coalesce(after[f"kv-{i}"], F.lit(0)).alias(v) for i, v in enumerate(COUNTERS)])


@query(
    f"""{with_clause('W1')}, p AS (SELECT *, lead(v0) OVER w AS n0, lead(v1) OVER w AS n1, lead(v2) OVER w AS n2 FROM W1 WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT key, seq, CASE WHEN v0 = n0 AND v1 = n1 AND v2 = n2 THEN 'equal' WHEN v0 <= n0 AND v1 <= n1 AND v2 <= n2 THEN 'before' WHEN v0 >= n0 AND v1 >= n1 AND v2 >= n2 THEN 'after' ELSE 'concurrent' END AS relation FROM p WHERE n0 IS NOT NULL"""
)
def clock_relation_pairs(spark, sf):
    from pyspark.sql import Window

    pairs = w1(spark, sf).withColumn("other", F.lead("clock").over(Window.partitionBy("key").orderBy("seq"))).filter("other is not null")
    return pairs.select("key", "seq", clocks.relation(F.col("clock"), F.col("other")).alias("relation"))


@query(f"{with_clause('W2')}, {deduped('d', 'W2')} SELECT key, seq, CAST(layer_rank AS BIGINT) AS layer_rank, v0, v1, v2, value FROM d")
def resolve_fold_equal_ties(spark, sf):
    return bigint(versions.first_of_equal(w2(spark, sf), ["key"], "clock", ["layer_rank", "seq"]).select("key", "seq", "layer_rank", *COUNTERS, "value"))


@query(f"{with_clause('W2')}, {deduped('d', 'W2')}, {maximal('s', 'd')} SELECT key, seq, CAST(layer_rank AS BIGINT) AS layer_rank, is_deleted, value FROM s")
def layer_merge(spark, sf):
    return bigint(layers.visible(w2(spark, sf)).select("key", "seq", "layer_rank", "is_deleted", "value"))


@query(
    f"""{with_clause('W1')}, b AS (SELECT *, max(CASE WHEN is_restore THEN seq END) OVER (PARTITION BY key) AS bar FROM W1),
r AS (SELECT * FROM b WHERE bar IS NULL OR seq >= bar), {maximal('s', 'r')} SELECT key, seq, is_deleted FROM s"""
)
def restore_barrier(spark, sf):
    return versions.replay(w1(spark, sf)).select("key", "seq", "is_deleted")


@query(f"{with_clause('W1')}, {maximal('s', 'W1')} SELECT key, count(*) AS n FROM s GROUP BY key HAVING bool_and(is_deleted)")
def tombstoned_keys(spark, sf):
    return versions.tombstoned(versions.survivors(w1(spark, sf)))


# Layers


@query(f"{with_clause('W2')} SELECT DISTINCT key FROM W2")
def distinct_keys_all_layers(spark, sf):
    return layers.keys_of(w2(spark, sf))


@query(f"{with_clause('W2')} SELECT CAST(layer_rank AS BIGINT) AS layer_rank, count(*) AS entries, CAST(sum(strlen(key) + length(CAST(value AS VARCHAR)) + 64) AS BIGINT) AS bytes FROM W2 GROUP BY layer_rank")
def memtable_size_by_layer(spark, sf):
    return bigint(layers.size_by_layer(w2(spark, sf).withColumn("value_json", F.col("value").cast("string"))))


TIERED = """t AS (SELECT *, greatest(0, length(CAST(size AS VARCHAR)) - 3) AS tier FROM FILES),
i AS (SELECT *, CASE WHEN tier = lag(tier) OVER (ORDER BY newest_rank) THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (ORDER BY newest_rank) AS run FROM i)"""


@query(f"{with_clause('FILES')}, {TIERED} SELECT CAST(tier AS BIGINT) AS tier, count(*) AS n, CAST(min(newest_rank) AS BIGINT) AS from_rank, CAST(max(newest_rank) AS BIGINT) AS to_rank FROM r GROUP BY run, tier")
def tier_runs(spark, sf):
    return bigint(layers.tier_runs(fixture(spark, sf, "FILES")).drop("run"))


@query(f"{with_clause('FILES')}, {TIERED} SELECT CAST(tier AS BIGINT) AS tier, count(*) AS n, CAST(min(newest_rank) AS BIGINT) AS from_rank, CAST(max(newest_rank) AS BIGINT) AS to_rank FROM r GROUP BY run, tier HAVING count(*) >= 4 ORDER BY n DESC, from_rank LIMIT 1")
def compaction_choice(spark, sf):
    return bigint(layers.chosen_run(fixture(spark, sf, "FILES")).drop("run"))


@query(f"{with_clause('MAN')} SELECT id FROM MAN GROUP BY id HAVING arg_max(op, seq) = 'ADD'")
def live_manifest(spark, sf):
    return layers.live_files(fixture(spark, sf, "MAN"))


@query(f"{with_clause('MAN')} SELECT id, row_number() OVER (ORDER BY id DESC) + 1 AS layer_rank FROM (SELECT id FROM MAN GROUP BY id HAVING arg_max(op, seq) = 'ADD')")
def ranked_files(spark, sf):
    return bigint(layers.ranked_files(layers.live_files(fixture(spark, sf, "MAN"))))


@query(f"{with_clause('W2')}, {deduped('d', 'W2', where='layer_rank BETWEEN 2 AND 4')}, {maximal('s', 'd')} SELECT key, seq, is_deleted, value FROM s")
def compaction_output(spark, sf):
    return layers.compacted(w2(spark, sf), 2, 4).select("key", "seq", "is_deleted", "value")


@query(f"{with_clause('W2')} SELECT key, arg_min(seq, CAST(layer_rank AS BIGINT) * 1000000000 - seq) AS seq, arg_min(value, CAST(layer_rank AS BIGINT) * 1000000000 - seq) AS value FROM W2 GROUP BY key")
def first_siblings(spark, sf):
    return layers.first_sibling(w2(spark, sf)).select("key", "seq", "value")


@query(f"{with_clause('W2')}, {deduped('d', 'W2')}, {maximal('s', 'd')} SELECT key, seq, value FROM s WHERE key = 'part-7'")
def point_read(spark, sf):
    return layers.visible(w2(spark, sf).filter("key = 'part-7'")).select("key", "seq", "value")


# Placement


@query(f"SELECT c_name AS key, {fnv('c_name')} AS hash, {fnv('c_name')} % 16 AS bucket FROM customer")
def key_hash(spark, sf):
    return customer_keys(spark, sf).select("key", hashes.fnv1a32(F.col("key")).alias("hash"), hashes.bucket_for(F.col("key"), 16).alias("bucket"))


@query(f"SELECT {fnv(ORDER_KEY)} % 16 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def bucket_counts(spark, sf):
    return order_keys(spark, sf).groupBy(hashes.bucket_for(F.col("key"), 16).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {ring('six', PODS)}, {keys('k', 'customer', 'c_name')}, {placed('p', 'k', 'six')} SELECT key, array_to_string(owners, ',') AS owners FROM p")
def preference_list(spark, sf):
    return placement.owners_of(customer_keys(spark, sf), PODS, 3).select("key", F.array_join("owners", ",").alias("owners"))


@query(f"WITH {ring('six', PODS)}, {keys('k', 'orders', ORDER_KEY)}, {placed('p', 'k', 'six')}, o AS (SELECT unnest(owners) AS pod FROM p) SELECT pod, count(*) AS keys, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM o GROUP BY pod")
def ownership_share(spark, sf):
    return placement.shares(placement.owners_of(order_keys(spark, sf), PODS, 3), PODS).withColumn("share", F.round("share", 6))


@query(f"WITH {ring('six', PODS)}, {keys('k', 'orders', ORDER_KEY)}, {placed('p', 'k', 'six')} SELECT place, owners[place] AS pod, count(*) AS n FROM p, (VALUES (1), (2), (3)) AS v(place) GROUP BY ALL")
def owner_rank_counts(spark, sf):
    each = placement.owners_of(order_keys(spark, sf), PODS, 3).select(F.posexplode("owners").alias("place", "pod"))
    return each.groupBy((F.col("place") + 1).alias("place"), "pod").agg(F.count("*").alias("n"))


@query(f"WITH {ring('six', PODS)} SELECT pos, m AS node FROM six_r")
def ring_positions(spark, sf):
    return placement.ring_frame(spark, PODS)


FAULTS = ", ".join(f"('{k}:{','.join(p)}', '{k}', [{', '.join(repr(x) for x in p)}], '{s}', '{t}')" for k, p in TOPOLOGY.standard_faults() for s, t in TOPOLOGY.sides(k, p))
EXPECT = """CASE WHEN kind = 'down' THEN CASE WHEN len(owners) - len(list_intersect(owners, pods)) >= 2 THEN 'ok' ELSE 'fail' END
 ELSE CASE WHEN (CASE WHEN list_contains(pods, target) THEN len(list_intersect(owners, pods)) ELSE len(owners) - len(list_intersect(owners, pods)) END) >= 2 THEN 'ok' ELSE 'fail' END END"""
PREDICTED = f"f AS (SELECT * FROM (VALUES {FAULTS}) AS v(fault, kind, pods, side, target)), e AS (SELECT p.key, p.owners, f.*, op, {EXPECT} AS expect FROM p, f, (VALUES ('put'), ('get')) AS o(op))"


@query(
    f"""WITH {ring('six', PODS)}, {keys('k', 'customer', 'c_name')}, {placed('p', 'k', 'six')}, {PREDICTED}
SELECT fault, side, op, CAST(count(*) FILTER (WHERE expect <> 'ok') AS BIGINT) AS fails, count(*) AS keys FROM e GROUP BY ALL
UNION ALL SELECT fault, 'nowhere', op, CAST(count(*) FILTER (WHERE bad) AS BIGINT), count(*) FROM (SELECT fault, op, key, bool_and(expect <> 'ok') AS bad FROM e GROUP BY ALL) GROUP BY fault, op"""
)
def zone_loss_summary(spark, sf):
    return chaos.summary(placement.owners_of(customer_keys(spark, sf), PODS, 3), chaos.faults_frame(spark, TOPOLOGY), TOPOLOGY)


@query(f"WITH {ring('six', PODS)}, {keys('k', 'customer', 'c_name')}, {placed('p', 'k', 'six')}, {PREDICTED} SELECT fault, side, target, op, expect, count(*) AS n FROM e WHERE kind = 'partition' GROUP BY ALL")
def partition_sides(spark, sf):
    both = chaos.predictions(placement.owners_of(customer_keys(spark, sf), PODS, 3), chaos.faults_frame(spark, TOPOLOGY).filter("kind = 'partition'"), TOPOLOGY)
    return both.groupBy("fault", "side", "target", "op", "expect").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ring('six', PODS)}, {keys('k', 'supplier', 's_name')}, {placed('p', 'k', 'six')}, {PREDICTED}
SELECT key, array_to_string(owners, ',') AS replicas, array_to_string(list_transform(owners, lambda o: CASE WHEN o IN ('kv-0', 'kv-5') THEN 'b' WHEN o IN ('kv-1', 'kv-4') THEN 'c' ELSE 'd' END), ',') AS zones,
 max(CASE WHEN side = 'group' AND op = 'put' THEN expect END) AS group_put, max(CASE WHEN side = 'rest' AND op = 'put' THEN expect END) AS rest_put FROM e WHERE fault = 'partition:kv-1,kv-4' GROUP BY key, owners"""
)
def predict_per_key(spark, sf):
    zones = F.create_map(*[F.lit(x) for kv in TOPOLOGY.zones.items() for x in kv])
    faults = chaos.faults_frame(spark, TOPOLOGY, [("partition", ["kv-1", "kv-4"])])
    each = chaos.predictions(placement.owners_of(table(spark, sf, "supplier").select(F.col("s_name").alias("key")), PODS, 3), faults, TOPOLOGY)
    expect = lambda side: F.max(F.when((F.col("side") == side) & (F.col("op") == "put"), F.col("expect"))).alias(f"{side}_put")
    return each.groupBy("key", F.array_join("owners", ",").alias("replicas"), F.array_join(F.transform("owners", lambda o: zones[o]), ",").alias("zones")).agg(expect("group"), expect("rest"))


def handed(before: list[str], after: list[str]) -> str:
    return f"""WITH {ring('a', before)}, {ring('b', after)}, {keys('k', 'orders', ORDER_KEY)}, {placed('p', 'k', 'a', 'old')}, {placed('q', 'p', 'b', 'new')},
h AS (SELECT key, source, unnest(CASE WHEN list_contains(new, source) THEN list_filter(new, lambda x: NOT list_contains(old, x)) ELSE new END) AS target FROM (SELECT *, unnest(old) AS source FROM q))"""


@query(f"{handed(PODS, SEVEN)} SELECT source, target, count(*) AS keys FROM h GROUP BY ALL")
def handoff_plan_scale_up(spark, sf):
    return placement.handoff(order_keys(spark, sf), PODS, SEVEN, 3).groupBy("source", "target").agg(F.count("*").alias("keys"))


@query(f"{handed(SEVEN, PODS)} SELECT source, target, count(*) AS keys FROM h GROUP BY ALL")
def handoff_plan_scale_down(spark, sf):
    return placement.handoff(order_keys(spark, sf), SEVEN, PODS, 3).groupBy("source", "target").agg(F.count("*").alias("keys"))


@query(f"WITH {ring('a', PODS)}, {ring('b', SEVEN)}, {keys('k', 'orders', ORDER_KEY)}, {placed('p', 'k', 'a', 'old')}, {placed('q', 'p', 'b', 'new')} SELECT count(*) AS keys, count(*) FILTER (WHERE len(list_filter(new, lambda x: NOT list_contains(old, x))) > 0) AS moved, round(count(*) FILTER (WHERE len(list_filter(new, lambda x: NOT list_contains(old, x))) > 0) / count(*), 6) AS share FROM q")
def moved_fraction(spark, sf):
    both = placement.owners_of(placement.owners_of(order_keys(spark, sf), PODS, 3, to="old"), SEVEN, 3, to="new")
    moved = F.count_if(F.size(F.array_except("new", "old")) > 0)
    return both.agg(F.count("*").alias("keys"), moved.alias("moved"), F.round(moved / F.count("*"), 6).alias("share"))


# Reconciliation


def replica(spark, sf, skip: int) -> DataFrame:
    df = w1(spark, sf).filter(F.col("seq") % skip != 0).withColumn("value_json", F.col("seq").cast("string"))
    return versions.survivors(df).withColumn("item", reconcile.item_text(F.col("value_json"), F.col("clock"), F.col("node"), F.col("is_deleted")))


def replica_sql(name: str, skip: int) -> str:
    item = "concat('value=', seq, '|vc={[', concat_ws(' ', CASE WHEN v0 > 0 THEN concat('kv-0:', v0) END, CASE WHEN v1 > 0 THEN concat('kv-1:', v1) END, CASE WHEN v2 > 0 THEN concat('kv-2:', v2) END), ']}|by=', node, '|deleted=', CAST(is_deleted AS VARCHAR))"
    return f"{name}_w AS (SELECT * FROM W1 WHERE seq % {skip} <> 0), {maximal(f'{name}_s', f'{name}_w')}, {name} AS (SELECT *, {item} AS item, {fnv('key')} % 16 AS bucket FROM {name}_s)"


def leaves_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT b AS bucket, sha256(coalesce(string_agg(t, '' ORDER BY key), '')) AS hash FROM range(16) AS r(b)
LEFT JOIN (SELECT bucket, key, concat(key, chr(0), string_agg(concat(item, chr(0)), '' ORDER BY item)) AS t FROM {source} GROUP BY bucket, key) ON bucket = b GROUP BY b)"""


@query(f"{with_clause('W1')}, {replica_sql('ra', 7)}, {leaves_sql('la', 'ra')} SELECT bucket, hash FROM la")
def merkle_leaves(spark, sf):
    return bigint(reconcile.leaves(replica(spark, sf, 7)))


@query(
    f"""{with_clause('W1')}, {replica_sql('ra', 7)}, {leaves_sql('la', 'ra')},
l3 AS (SELECT a.bucket // 2 AS i, sha256(unhex(a.hash) || unhex(b.hash)) AS hash FROM la a JOIN la b ON b.bucket = a.bucket + 1 WHERE a.bucket % 2 = 0),
l2 AS (SELECT a.i // 2 AS i, sha256(unhex(a.hash) || unhex(b.hash)) AS hash FROM l3 a JOIN l3 b ON b.i = a.i + 1 WHERE a.i % 2 = 0),
l1 AS (SELECT a.i // 2 AS i, sha256(unhex(a.hash) || unhex(b.hash)) AS hash FROM l2 a JOIN l2 b ON b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT sha256(unhex(a.hash) || unhex(b.hash)) AS hash FROM l1 a JOIN l1 b ON b.i = a.i + 1 WHERE a.i = 0"""
)
def merkle_root(spark, sf):
    return reconcile.tree(reconcile.leaves(replica(spark, sf, 7))).filter("node_index = 0").select("hash")


@query(f"{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)}, {leaves_sql('la', 'ra')}, {leaves_sql('lb', 'rb')} SELECT la.bucket FROM la JOIN lb USING (bucket) WHERE la.hash <> lb.hash")
def divergent_buckets(spark, sf):
    return bigint(reconcile.divergent(reconcile.leaves(replica(spark, sf, 7)), reconcile.leaves(replica(spark, sf, 5))))


def uncovered(have: str, incoming: str) -> str:
    return f"SELECT a.* FROM {incoming} a WHERE NOT EXISTS (SELECT 1 FROM {have} b WHERE b.key = a.key AND {COVERED})"


@query(f"{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)} SELECT key, seq FROM ({uncovered('ra', 'rb')})")
def missing_from_pull(spark, sf):
    return versions.missing_from(replica(spark, sf, 7), replica(spark, sf, 5)).select("key", "seq")


@query(f"{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)} SELECT key, seq FROM ({uncovered('rb', 'ra')})")
def missing_from_push(spark, sf):
    return versions.missing_from(replica(spark, sf, 5), replica(spark, sf, 7)).select("key", "seq")


@query(
    f"""{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)}, ua AS (SELECT * FROM ra UNION ALL {uncovered('ra', 'rb')}), ub AS (SELECT * FROM rb UNION ALL {uncovered('rb', 'ra')}),
{maximal('ma', 'ua')}, {maximal('mb', 'ub')}
SELECT (SELECT count(*) FROM ma) AS local, (SELECT count(*) FROM mb) AS remote, (SELECT count(*) FROM (SELECT key, seq FROM ma EXCEPT SELECT key, seq FROM mb)) + (SELECT count(*) FROM (SELECT key, seq FROM mb EXCEPT SELECT key, seq FROM ma)) AS different"""
)
def reconciled_equals(spark, sf):
    a, b = reconcile.reconciled(replica(spark, sf, 7), replica(spark, sf, 5))
    sides = a.select("key", "seq", F.lit(1).alias("side")).unionByName(b.select("key", "seq", F.lit(2).alias("side")))
    each = sides.groupBy("key", "seq").agg(F.count_if(F.col("side") == 1).alias("l"), F.count_if(F.col("side") == 2).alias("r"))
    return each.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("local"), F.coalesce(F.sum("r"), F.lit(0)).alias("remote"), F.count_if((F.col("l") == 0) | (F.col("r") == 0)).alias("different"))


REQUESTS = f"{with_clause('Q1')}, {ring('six', PODS)}, k AS (SELECT *, {fnv('key')} AS h FROM Q1), {placed('p', 'k', 'six')}"


def requests(spark, sf) -> DataFrame:
    return fixture(spark, sf, "Q1")


def owned_requests(spark, sf) -> DataFrame:
    return placement.owners_of(requests(spark, sf), PODS, 3)


DOWN = ["kv-0", "kv-2"]


@query(f"{REQUESTS} SELECT seq, CAST(len(owners) - len(list_intersect(owners, ['kv-0', 'kv-2'])) AS BIGINT) AS acks, len(owners) - len(list_intersect(owners, ['kv-0', 'kv-2'])) >= 2 AS ok FROM p WHERE op = 'put'")
def quorum_write_outcome(spark, sf):
    acks, ok = reconcile.write_outcome(F.col("owners"), F.lit(DOWN), TOPOLOGY.w)
    return owned_requests(spark, sf).filter("op = 'put'").select("seq", acks.cast("long").alias("acks"), ok.alias("ok"))


@query(
    f"""{with_clause('W1')}, {replica_sql('ra', 7)}, {replica_sql('rb', 5)}, u AS (SELECT 0 AS rank, key, seq, v0, v1, v2 FROM ra UNION ALL SELECT 1, key, seq, v0, v1, v2 FROM rb),
{deduped('d', 'u', 'rank, seq')}, {maximal('s', 'd')} SELECT key, seq, CAST(rank AS BIGINT) AS rank FROM s"""
)
def quorum_read_merge(spark, sf):
    answers = None
    for rank, skip in enumerate((7, 5, 3)):
        one = replica(spark, sf, skip).withColumn("rank", F.lit(rank))
        answers = one if answers is None else answers.unionByName(one)
    return bigint(reconcile.quorum_read(answers, 2).select("key", "seq", "rank"))


@query(f"{REQUESTS} SELECT seq, list_filter(owners, lambda o: o NOT IN ('kv-0', 'kv-2'))[1] AS forwarded FROM p WHERE NOT list_contains(owners, target)")
def forward_target(spark, sf):
    rows = owned_requests(spark, sf).filter(~F.array_contains("owners", F.col("target")))
    return rows.select("seq", placement.first_live(F.col("owners"), F.lit(DOWN)).alias("forwarded"))


@query(f"{REQUESTS} SELECT target2 AS target, count(*) AS hints, count(DISTINCT key) AS keys FROM (SELECT key, unnest(list_filter(owners, lambda o: o IN ('kv-0', 'kv-2'))) AS target2 FROM p WHERE op = 'put' AND result = 'ok') GROUP BY 1")
def hints_created(spark, sf):
    rows = owned_requests(spark, sf).filter("op = 'put'").withColumn("unreachable", F.array_intersect("owners", F.lit(DOWN)))
    return reconcile.hints(rows.drop("target")).groupBy("target").agg(F.count("*").alias("hints"), F.count_distinct("key").alias("keys"))


HINTED = "hh AS (SELECT key, seq, node AS target, v0, v1, v2 FROM W1), dd AS (SELECT node AS target, key, max(v0) AS v0, max(v1) AS v1, max(v2) AS v2 FROM W1 WHERE seq % 4 < 2 GROUP BY node, key)"


@query(f"{with_clause('W1')}, {HINTED} SELECT target, count(*) AS pending FROM hh a WHERE NOT EXISTS (SELECT 1 FROM dd b WHERE b.key = a.key AND b.target = a.target AND {COVERED}) GROUP BY target")
def hints_pending(spark, sf):
    hinted = w1(spark, sf).select("key", "seq", F.col("node").alias("target"), "clock")
    marks = versions.context(hinted.filter("seq % 4 < 2"), ("target", "key")).withColumnRenamed("context", "clock")
    return reconcile.pending(hinted, marks).groupBy("target").agg(F.count("*").alias("pending"))


# Chaos checking


LINES = f"""lines AS (SELECT test, max(CASE WHEN event = 'inject' THEN fault END) AS fault, min(CASE WHEN event = 'inject' THEN time_ns END) AS inject, min(CASE WHEN event = 'heal' THEN time_ns END) AS heal,
 min(CASE WHEN mark = 'serving' THEN time_ns END) AS serving, min(CASE WHEN mark = 'serving-kv-2' THEN time_ns END) AS back FROM T GROUP BY test),
wins AS (SELECT *, inject - {TOLERANCE} AS in_from, inject + 3500000000 + {TOLERANCE} AS in_to, least(heal, coalesce(serving, heal)) - {TOLERANCE} AS out_from, heal + 7500000000 + {TOLERANCE} AS out_to,
 back - {TOLERANCE} AS b_from, back + 7500000000 + {TOLERANCE} AS b_to FROM lines),
ph AS (SELECT q.*, w.fault, w.back, w.in_from, w.in_to, w.test IS NOT NULL AS judged, CASE WHEN w.test IS NULL THEN 'normal'
 WHEN (q.start <= in_to AND q."end" >= in_from) OR coalesce(q.start <= out_to AND q."end" >= out_from, false) OR coalesce(q.start <= b_to AND q."end" >= b_from, false) THEN 'transition'
 WHEN q.start > inject AND (heal IS NULL OR q."end" < heal) THEN 'fault' ELSE 'normal' END AS phase FROM Q1 q LEFT JOIN wins w ON w.test = q.test)"""
JUDGED = f"""{with_clause('Q1', 'T')}, {LINES}, {ring('six', PODS)}, k AS (SELECT *, {fnv('key')} AS h FROM ph), {placed('p', 'k', 'six')},
acks AS (SELECT key, min("end") AS acked FROM Q1 WHERE op = 'put' AND result = 'ok' GROUP BY key),
j0 AS (SELECT p.*, acked, CASE WHEN target LIKE 'kv-%' THEN target ELSE '' END AS tgt, CASE WHEN fault LIKE 'down%' THEN CASE WHEN start >= back THEN ['kv-0'] ELSE ['kv-0', 'kv-2'] END WHEN fault IS NOT NULL THEN ['kv-1', 'kv-4'] ELSE [] END AS pods FROM p LEFT JOIN acks ON acks.key = p.key),
j1 AS (SELECT *, len(list_intersect(owners, pods)) AS inside, 3 - len(list_intersect(owners, pods)) AS outside FROM j0),
j2 AS (SELECT *, CASE WHEN phase <> 'fault' THEN 'ok' WHEN fault LIKE 'down%' THEN CASE WHEN tgt <> '' AND list_contains(pods, tgt) THEN 'target-down' WHEN outside >= 2 THEN 'ok' ELSE 'fail' END
 WHEN tgt = '' THEN CASE WHEN (inside >= 2) = (outside >= 2) THEN CASE WHEN inside >= 2 THEN 'ok' ELSE 'fail' END ELSE 'unknowable' END
 WHEN list_contains(pods, tgt) THEN CASE WHEN inside >= 2 THEN 'ok' ELSE 'fail' END ELSE CASE WHEN outside >= 2 THEN 'ok' ELSE 'fail' END END AS expect,
 CASE WHEN fault IS NULL THEN 0 WHEN fault LIKE 'down%' THEN inside WHEN tgt = '' THEN -1 WHEN list_contains(pods, tgt) THEN outside ELSE inside END AS unr FROM j1),
j AS (SELECT *, CASE WHEN result = 'dropped' THEN 'dropped' WHEN op = 'get' AND result IN ('notfound', 'mismatch') AND coalesce(acked < start, false) THEN 'stale-read'
 WHEN op = 'get' AND result = 'notfound' THEN 'unjudged-read' WHEN phase = 'transition' THEN 'transition'
 WHEN expect = 'fail' AND result NOT IN ('failed', 'unknown') THEN 'unexpected-success' WHEN expect = 'target-down' AND result NOT IN ('failed', 'unknown') THEN 'target-down-ok'
 WHEN expect = 'unknowable' THEN 'unknowable' WHEN expect = 'ok' AND result IN ('failed', 'unknown') THEN CASE WHEN tgt = '' THEN 'service-failure' ELSE 'unexpected-failure' END ELSE 'as-predicted' END AS bucket,
 op = 'put' AND result = 'ok' AND judged AND phase = 'transition' AND unr <> 0 AND start <= in_to AND "end" >= in_from AS under FROM j2)"""


def lines(spark, sf) -> DataFrame:
    return chaos.timelines(fixture(spark, sf, "T"), TOPOLOGY, TOLERANCE)


def judged(spark, sf) -> DataFrame:
    return chaos.judged(requests(spark, sf), lines(spark, sf), TOPOLOGY)


@query(f"{with_clause('Q1', 'T')}, {LINES} SELECT test, seq, phase FROM ph")
def request_phase(spark, sf):
    return chaos.phased(requests(spark, sf), lines(spark, sf)).select("test", "seq", "phase")


@query(f"{with_clause('Q1', 'T')}, {LINES} SELECT test, phase, op, result, count(*) AS n FROM ph GROUP BY ALL")
def phase_op_result_counts(spark, sf):
    return chaos.phase_counts(chaos.phased(requests(spark, sf), lines(spark, sf)))


@query(f"{JUDGED} SELECT test, bucket, count(*) AS n FROM j GROUP BY ALL")
def request_bucket_counts(spark, sf):
    return chaos.bucket_counts(judged(spark, sf))


@query(f"{JUDGED} SELECT test, bucket, place, seq, key FROM (SELECT *, row_number() OVER (PARTITION BY test, bucket ORDER BY seq) AS place FROM j WHERE bucket NOT IN ('as-predicted', 'dropped')) WHERE place <= 5")
def bucket_examples(spark, sf):
    return bigint(chaos.examples(judged(spark, sf)).select("test", "bucket", "place", "seq", "key"))


@query(
    f"""{JUDGED}, c AS (SELECT *, op = 'put' AND result = 'ok' AND judged AS ok FROM j)
SELECT test, CAST(sum(CASE WHEN ok AND phase = 'fault' AND unr >= 0 THEN unr ELSE 0 END) AS BIGINT) AS hints, CAST(sum(CASE WHEN ok AND phase = 'transition' AND unr > 0 THEN unr ELSE 0 END) AS BIGINT) AS hints_maybe,
 count(*) FILTER (WHERE ok AND phase = 'fault' AND unr < 0) AS hints_unknown, count(*) FILTER (WHERE under) AS under_replicated FROM c GROUP BY test"""
)
def hint_totals(spark, sf):
    return chaos.hint_totals(judged(spark, sf))


@query(f"""{with_clause('Q1')} SELECT key, min("end") AS acked_end FROM Q1 WHERE op = 'put' AND result = 'ok' GROUP BY key""")
def first_ack(spark, sf):
    return chaos.first_acks(requests(spark, sf))


@query(f"""{with_clause('Q1')}, acks AS (SELECT key, min("end") AS acked FROM Q1 WHERE op = 'put' AND result = 'ok' GROUP BY key) SELECT seq, Q1.key FROM Q1 JOIN acks ON acks.key = Q1.key WHERE op = 'get' AND result IN ('notfound', 'mismatch') AND acked < start""")
def stale_reads(spark, sf):
    rows = requests(spark, sf)
    return rows.join(chaos.first_acks(rows), "key").filter("op = 'get' and result in ('notfound', 'mismatch') and acked_end < start").select("seq", "key")


@query(f"{with_clause('RBK')} SELECT key, arg_max(result, time_ns) AS result, max(time_ns) AS time_ns FROM RBK GROUP BY key")
def latest_readback(spark, sf):
    return chaos.latest(fixture(spark, sf, "RBK")).select("key", "result", "time_ns")


READ = f"""{JUDGED.replace("WITH Q1", with_clause("RBK") + ", Q1", 1)}, last AS (SELECT key, arg_max(result, time_ns) AS result, arg_max(n_holders, time_ns) AS holders FROM RBK GROUP BY key),
u AS (SELECT DISTINCT key FROM j WHERE under), m AS (SELECT acks.key, last.result, last.holders, u.key IS NOT NULL AS allowed FROM acks LEFT JOIN last ON last.key = acks.key LEFT JOIN u ON u.key = acks.key),
una AS (SELECT DISTINCT key FROM Q1 WHERE op = 'put' AND result IN ('failed', 'unknown') AND key NOT IN (SELECT key FROM acks)),
rep AS (SELECT count(*) AS acked, count(*) FILTER (WHERE result IS NULL) AS not_read_back, count(*) FILTER (WHERE result IN ('notfound', 'mismatch')) AS lost, count(*) FILTER (WHERE result NOT IN ('ok', 'notfound', 'mismatch')) AS unreadable,
 count(*) FILTER (WHERE result IS NOT NULL) AS copies_checked, count(*) FILTER (WHERE holders < 3) AS under_replicated, count(*) FILTER (WHERE holders < 3 AND allowed) AS under_replicated_expected, count(*) FILTER (WHERE holders < 3 AND NOT allowed) AS under_replicated_unexpected,
 (SELECT count(*) FROM una JOIN last USING (key) WHERE result = 'ok') AS unacked_present, (SELECT count(*) FROM una JOIN last USING (key) WHERE result = 'notfound') AS unacked_absent FROM m)"""


def report(spark, sf, rows: DataFrame) -> DataFrame:
    return chaos.readback_report(requests(spark, sf), fixture(spark, sf, "RBK"), rows.filter("expected_under"))


@query(f"{READ} SELECT * FROM rep")
def readback_report(spark, sf):
    return report(spark, sf, judged(spark, sf))


@query(f"{READ}, v AS (SELECT count(*) FILTER (WHERE bucket IN ('unexpected-success', 'unexpected-failure', 'stale-read')) AS violations FROM j) SELECT violations, lost, not_read_back, unreadable, under_replicated_unexpected, violations = 0 AND lost = 0 AND not_read_back = 0 AND unreadable = 0 AND under_replicated_unexpected = 0 AS ok FROM v, rep")
def check_verdict(spark, sf):
    rows = judged(spark, sf)
    return chaos.verdict(rows, report(spark, sf, rows))


@query(f"{with_clause('T')}, i AS (SELECT test, min(time_ns) AS inject FROM T WHERE event = 'inject' GROUP BY test) SELECT T.test, coalesce(mark, event) AS mark, round((time_ns - inject) / 1000000000.0::DOUBLE, 1) AS seconds FROM T JOIN i USING (test) WHERE event <> 'inject'")
def timeline_offsets(spark, sf):
    return chaos.offsets(fixture(spark, sf, "T"))


# Telemetry


INCREASED = "c AS (SELECT *, CAST(CASE WHEN lag(counter_value) OVER w IS NULL THEN 0 WHEN counter_value < lag(counter_value) OVER w THEN counter_value ELSE counter_value - lag(counter_value) OVER w END AS BIGINT) AS increase FROM MT WINDOW w AS (PARTITION BY instance, code ORDER BY time_us, sample))"


@query(f"{with_clause('MT')}, {INCREASED} SELECT instance, code, CAST(sum(increase) AS BIGINT) AS increase, count(*) AS samples FROM c GROUP BY ALL")
def counter_increase(spark, sf):
    return telemetry.total_increase(fixture(spark, sf, "MT"), ["instance", "code"], ["instance", "code"])


@query(f"{with_clause('MT')}, {INCREASED} SELECT code, time_us // 3600000000 * 3600000000 AS step, CAST(sum(increase) AS BIGINT) AS increase, round(sum(increase) / 3600.0::DOUBLE, 6) AS rate FROM c GROUP BY ALL")
def rate_by_label(spark, sf):
    return telemetry.rates(fixture(spark, sf, "MT"), ["instance", "code"], ["code"], 3_600_000_000).withColumn("rate", F.round("rate", 6))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0]
BUCKETED = f"""b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES {', '.join(f'({x}::DOUBLE)' for x in BOUNDS)}, ('Infinity'::DOUBLE)) AS v(le) GROUP BY ALL)"""


@query(f"WITH {BUCKETED} SELECT event_type, CAST(le AS VARCHAR) AS le, n FROM b")
def histogram_buckets(spark, sf):
    h = telemetry.histogram(table(spark, sf, "events"), BOUNDS, by=["event_type"])
    return h.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


@query(
    f"""WITH {BUCKETED}, l AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)),
h AS (SELECT event_type, le, CASE WHEN le = 'Infinity' THEN 400.0 ELSE lo + (le - lo) * (total * 0.9::DOUBLE - below) / (n - below) END AS v FROM l WHERE n >= total * 0.9::DOUBLE)
SELECT event_type, round(arg_min(v, le), 6) AS quantile, arg_min(v, le) >= 400 AS at_top FROM h GROUP BY event_type"""
)
def histogram_quantile(spark, sf):
    h = telemetry.histogram(table(spark, sf, "events"), BOUNDS, by=["event_type"])
    return telemetry.histogram_quantile(h, 0.9, ["event_type"], 1.0).withColumn("quantile", F.round("quantile", 6))


@query(f"{with_clause('MT')} SELECT instance, code, time_us // 900000000 * 900000000 AS step, arg_max(counter_value, sample) AS value, count(*) AS samples FROM MT GROUP BY ALL")
def window_resample(spark, sf):
    return telemetry.resampled(fixture(spark, sf, "MT"), ["instance", "code"], 900_000_000, order="sample")


@query(
    f"""{with_clause('RS')}, i AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000.0::DOUBLE AS at_s, value, event_type <> 'error' AS ok FROM events),
s AS (SELECT RS.*, i.* FROM i JOIN RS ON at_s >= from_s AND at_s < to_s)
SELECT CAST(step AS BIGINT) AS step, CAST(target_rate AS BIGINT) AS target_rate, CAST(to_s - from_s AS BIGINT) AS seconds, count(*) AS started, round(count(*) / (to_s - from_s)::DOUBLE, 1) AS achieved_rate, count(*) FILTER (WHERE ok) AS n,
 round(quantile_cont(CASE WHEN ok THEN value END, 0.5), 6) AS p50_ms, round(quantile_cont(CASE WHEN ok THEN value END, 0.95), 6) AS p95_ms, round(quantile_cont(CASE WHEN ok THEN value END, 0.99), 6) AS p99_ms, max(CASE WHEN ok THEN value END) AS max_ms,
 count(*) FILTER (WHERE NOT ok) AS errors, CAST(greatest(0, target_rate * (to_s - from_s) - count(*)) AS BIGINT) AS dropped FROM s GROUP BY step, target_rate, from_s, to_s"""
)
def step_stats(spark, sf):
    events = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = events.agg(F.min("us").alias("first"))
    each = events.crossJoin(F.broadcast(first)).withColumn("at_s", (F.col("us") - F.col("first")) / 1e6)  # one row
    stats = telemetry.step_stats(telemetry.in_steps(each, fixture(spark, sf, "RS")), "value", F.col("event_type") != "error")
    return bigint(stats.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")}))


@query(f"{with_clause('Q1')}, c AS (SELECT target, count(*) AS n FROM Q1 WHERE target LIKE 'kv-%' GROUP BY target) SELECT round(max(n) / quantile_cont(n, 0.5), 6) AS max_over_median, round(min(n) / quantile_cont(n, 0.5), 6) AS min_over_median FROM c")
def spread(spark, sf):
    counts = requests(spark, sf).filter("target like 'kv-%'").groupBy("target").agg(F.count("*").alias("n"))
    return telemetry.spread(counts).select(*[F.round(c, 6).alias(c) for c in ("max_over_median", "min_over_median")])


@query(
    """WITH p AS (SELECT user_id % 10 AS peer, event_id AS seq, event_type NOT IN ('error', 'signup', 'view') AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY peer ORDER BY seq) AS island FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY peer, island ORDER BY seq) AS place FROM i WHERE NOT ok)
SELECT peer, count(*) AS missed, min(CASE WHEN place = 3 THEN seq END) AS dead_from FROM m GROUP BY peer, island HAVING count(*) >= 3"""
)
def failure_detector(spark, sf):
    pings = table(spark, sf, "events").select((F.col("user_id") % 10).alias("peer"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "signup", "view")).alias("ok"))
    return telemetry.dead_spells(pings, 3, ["peer"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def status_changes(spark, sf):
    return telemetry.changes(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", "event_id")


# Membership, plans, scalars


@query(f"{with_clause('ANN')}, h AS (SELECT *, max(epoch) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ANN), f AS (SELECT h.*, (SELECT arg_min(fingerprint, a.seq) FROM ANN a WHERE a.node = h.node AND a.epoch = h.held AND a.seq < h.seq) AS fp FROM h) SELECT node, seq, CASE WHEN held IS NULL OR epoch > held THEN 'adopted' WHEN epoch < held THEN 'stale' WHEN fingerprint = fp THEN 'no-op' ELSE 'conflict' END AS effect FROM f")
def epoch_effects(spark, sf):
    return membership.announced(fixture(spark, sf, "ANN")).select("node", "seq", "effect")


@query(f"{with_clause('ANN')} SELECT epoch, count(*) AS views, count(DISTINCT fingerprint) AS member_sets, count(DISTINCT fingerprint) > 1 AS conflict FROM ANN GROUP BY epoch")
def epoch_conflicts(spark, sf):
    views = fixture(spark, sf, "ANN").withColumn("members", F.create_map(F.lit("kv-0"), "fingerprint"))
    return membership.census(views)


@query(f"{with_clause('STAGES')}, w AS (SELECT *, coalesce(lag(rate) OVER (ORDER BY place), 50) AS before FROM STAGES) SELECT CAST(sum((before + rate) * move // 2 + rate * hold) AS BIGINT) AS writes, sum((before + rate) * move // 2 + rate * hold) <= 130000 AS allowed FROM w")
def planned_writes(spark, sf):
    return telemetry.planned_writes(fixture(spark, sf, "STAGES"), 50, 130_000)


@query(f"{with_clause('CODES')} SELECT code, msg, CASE WHEN code IS NULL THEN 'ok' WHEN code IN ('Canceled', 'DeadlineExceeded') THEN 'unknown' WHEN code = 'Unavailable' AND NOT regexp_matches(msg, 'quorum not reached|no replica accepted|local write failed|local read failed') THEN 'unknown' ELSE 'failed' END AS result FROM CODES")
def result_classify(spark, sf):
    return fixture(spark, sf, "CODES").select("code", "msg", scalars.classify_result(F.col("code"), F.col("msg")).alias("result"))


@query(f"{with_clause('SPECS')} SELECT spec, split_part(spec, ':', 1) AS kind, CASE WHEN spec = 'none' THEN 'none' ELSE split_part(spec, ':', 1) || ':' || array_to_string(list_sort(list_distinct(string_split(split_part(spec, ':', 2), ','))), ',') END AS fault FROM SPECS")
def fault_parse(spark, sf):
    kind, pods = scalars.fault_kind(F.col("spec")), scalars.fault_pods(F.col("spec"))
    return fixture(spark, sf, "SPECS").select("spec", kind.alias("kind"), scalars.fault_text(kind, pods).alias("fault"))


@query("SELECT CAST(greatest(0, length(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) - 3) AS BIGINT) AS tier, count(*) AS n FROM lineitem GROUP BY 1")
def size_tier(spark, sf):
    size = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf, "lineitem").groupBy(scalars.size_tier(size).cast("long").alias("tier")).agg(F.count("*").alias("n"))
