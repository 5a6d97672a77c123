"""Consistent-hash placement: a ring of members, its segments, owners of keys, and what moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions.hashes import VNODES, fnv1a32, fnv1a32_py

#: Segments up to which they are broadcast: members times VNODES and one.
BROADCAST_SEGMENTS = 200_000
CELL_BITS = 20


def ring(members: Sequence[str], vnodes: int = VNODES) -> list[tuple[int, str]]:
    """Positions and members in order; where two fall on one position, the smaller id has it."""
    if any(not m for m in members) or len(set(members)) != len(members):
        raise ValueError("member ids must be distinct and not empty")
    at: dict[int, str] = {}
    for m in members:
        for i in range(vnodes):
            p = fnv1a32_py(f"{m}-{i}")
            at[p] = min(at.get(p, m), m)
    return sorted(at.items())


def segments(members: Sequence[str], n: int, vnodes: int = VNODES) -> list[tuple[int, int, list[str]]]:
    """(lo, hi, owners): which distinct members, clockwise, own hashes lo to hi; the first and last parts belong together."""
    positions = ring(members, vnodes)
    if not positions:
        return [(0, (1 << 32) - 1, [])]
    out, low = [], 0
    for i, (p, _) in enumerate(positions):
        owners: list[str] = []
        for j in range(len(positions)):
            m = positions[(i + j) % len(positions)][1]
            if m not in owners:
                owners.append(m)
                if len(owners) == n:
                    break
        out.append((low, p, owners))
        low = p + 1
    return [*out, (low, (1 << 32) - 1, out[0][2])]


def owners_of(keys: DataFrame, members: Sequence[str], n: int, *, key: str = "key", to: str = "owners") -> DataFrame:
    """keys with the ordered owners of each key: an as-of join of its hash with the segments.

    Hashes and segments meet in cells of 4096 positions, so the join is on equality and each key meets
    the few segments of its cell; the segments are broadcast, members x VNODES + 1 rows.
    """
    spark = keys.sparkSession
    told = segments(members, n)
    frame = spark.createDataFrame(told, "__lo long, __hi long, __owners array<string>")
    shift = 32 - CELL_BITS if len(told) > 4096 else 32 - 8
    frame = frame.filter("__lo <= __hi").withColumn("__cell", F.explode(F.sequence(F.shiftright("__lo", shift), F.shiftright("__hi", shift))))
    hashed = keys.withColumn("__h", fnv1a32(F.col(key))).withColumn("__cell", F.shiftright("__h", shift))
    small = F.broadcast(frame) if len(told) <= BROADCAST_SEGMENTS else frame
    return hashed.join(small, "__cell").filter("__h between __lo and __hi").withColumn(to, F.col("__owners")).drop("__cell", "__h", "__lo", "__hi", "__owners")


def shares(placed: DataFrame, members: Sequence[str]) -> DataFrame:
    """(pod, keys, share): how much of placed (owners) each member holds, members without any included."""
    spark = placed.sparkSession
    counted = placed.select(F.explode("owners").alias("pod")).groupBy("pod").agg(F.count("*").alias("keys"))
    total = placed.agg(F.count("*").alias("total"))
    pods = spark.createDataFrame([(m,) for m in members], "pod string")
    return pods.join(counted, "pod", "left").crossJoin(total).select("pod", F.coalesce("keys", F.lit(0)).alias("keys"), (F.coalesce("keys", F.lit(0)) / F.col("total")).alias("share"))


def handoff(keys: DataFrame, before: Sequence[str], after: Sequence[str], n: int, *, key: str = "key") -> DataFrame:
    """keys with source and target: who sends each key to whom when the membership changes.

    An owner that stays one sends to owners that are new; one that no longer owns the key to every new owner.
    """
    placed = owners_of(owners_of(keys, before, n, key=key, to="old_owners"), after, n, key=key, to="new_owners")
    sent = placed.withColumn("source", F.explode("old_owners"))
    to = F.when(F.array_contains("new_owners", F.col("source")), F.array_except("new_owners", "old_owners")).otherwise(F.col("new_owners"))
    return sent.withColumn("target", F.explode(to)).drop("old_owners", "new_owners")


def ring_frame(spark: SparkSession, members: Sequence[str], vnodes: int = VNODES) -> DataFrame:
    return spark.createDataFrame(ring(members, vnodes), "pos long, node string")


def shares_replica(owners, a, b):
    """Whether members a and b both own a key."""
    return F.array_contains(owners, a) & F.array_contains(owners, b)


def first_live(owners, dead):
    """The first owner, in order of preference, that isn't dead; null if all are."""
    return F.get(F.filter(owners, lambda o: ~F.array_contains(dead, o)), F.lit(0))


def without_self(owners, node):
    """A node's peers for a key, in order of preference, and whether it is one of the owners itself."""
    return F.filter(owners, lambda o: o != node), F.array_contains(owners, node)


def views(sizes: DataFrame, members: str = "members", n: int = 3, vnodes: int = VNODES) -> DataFrame:
    """sizes (members: array of ids) with the ring that a view of them builds: positions taken, and those of the smallest and largest."""
    names = F.explode(F.transform(members, lambda m: F.struct(m.alias("m"), F.sequence(F.lit(0), F.lit(vnodes - 1)).alias("i"))))
    keys = [c for c in sizes.columns if c != members]
    each = sizes.select(*keys, names.alias("x")).select(*keys, "x.m", F.explode("x.i").alias("i"))
    at = each.withColumn("pos", fnv1a32(F.concat("m", F.lit("-"), "i")))
    return at.groupBy(*keys).agg(F.count_distinct("pos").alias("positions"), F.min("pos").alias("lowest"), F.max("pos").alias("highest"))


def with_member(positions: Sequence[tuple[int, str]], member: str, vnodes: int = VNODES) -> list[tuple[int, str]]:
    """A ring's positions after one more member joins: the same as of a ring built of all at once."""
    at = dict(positions)
    for i in range(vnodes):
        p = fnv1a32_py(f"{member}-{i}")
        at[p] = min(at.get(p, member), member)
    return sorted(at.items())
