"""Causal versioning: which versions of a key survive, in set form and as a fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions import clocks

#: Versions of one key that are compared in one row; larger keys are cut into pieces of this size first.
PIECE = 256


def first_of_equal(df: DataFrame, keys: Sequence[str], clock: str, order: Sequence[str]) -> DataFrame:
    """One row for each key and clock: the first in fold order."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.withColumn("__c", clocks.canonical(F.col(clock))).groupBy(*keys, "__c").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return grouped.select(*keys, "__c", "__r.*")


def maximal(versions: Column) -> Column:
    """Of an array of structs with a clock c and its total t, those whose clock no other covers.

    A clock that covers another has the larger total, so in falling order of totals what is kept is never lost.
    """
    places = F.sort_array(F.transform(versions, lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"))), asc=False)
    ordered = F.transform(places, lambda p: F.get(versions, p["i"]))
    covered = lambda kept, x: F.exists(kept, lambda y: clocks.covers(y["c"], x["c"]))
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, x: F.when(covered(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def survivors(df: DataFrame, keys: Sequence[str] = ("key",), clock: str = "clock", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The versions of each key that no other version covers; of equal clocks the first in order.

    Equal clocks are dropped by a partial aggregation. Then pieces of about PIECE versions of a key are
    reduced on their own, so a key with very many versions is dealt to many tasks, and what is left of
    keys in several pieces is compared by an anti join on the key, whose skewed partitions Spark splits.
    """
    keys, columns = list(keys), df.columns
    rest = [c for c in columns if c not in keys]
    one = first_of_equal(df, keys, clock, order).withColumn("__m", F.map_from_entries("__c"))
    many = one.groupBy(*keys).agg(F.count("*").alias("__n"))
    version = F.struct(clocks.total(F.col("__m")).alias("t"), F.col("__m").alias("c"), F.struct(*rest).alias("r"))
    dealt = one.join(many, keys).withColumn("__piece", F.pmod(F.xxhash64("__c"), F.ceil(F.col("__n") / PIECE)))
    held = dealt.groupBy(*keys, "__n", "__piece").agg(F.collect_list(version).alias("v"))
    left = held.select(*keys, (F.col("__n") > PIECE).alias("__open"), F.explode(maximal(F.col("v"))).alias("x"))
    left = left.select(*keys, "__open", F.col("x.c").alias("__m"), F.col("x.t").alias("__t"), "x.r.*")
    rivals = left.filter("__open").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__m").alias("__om"), F.col("__t").alias("__ot"))
    beaten = F.col("__open") & (F.col("__ot") > F.col("__t")) & clocks.covers(F.col("__om"), F.col("__m"))
    for k in keys:
        beaten = (F.col(k) == F.col(f"__k_{k}")) & beaten
    return left.join(rivals, beaten, "left_anti").select(*columns)


def fold(existing: Column, incoming: Column) -> Column:
    """Resolve incoming (a struct with clock) against an array of siblings, oldest first."""
    stays = F.exists(existing, lambda x: clocks.covers(x["clock"], incoming["clock"]))
    rest = F.filter(existing, lambda x: ~clocks.covers(incoming["clock"], x["clock"]))
    return F.when(stays, existing).otherwise(F.concat(rest, F.array(incoming)))


def merge_siblings(a: Column, b: Column) -> Column:
    return F.aggregate(b, a, fold)


def folded(df: DataFrame, keys: Sequence[str] = ("key",), clock: str = "clock", order: Sequence[str] = ("seq",)) -> DataFrame:
    """What the fold over all versions of each key leaves, whatever their number.

    Pieces of about PIECE versions are folded on their own, the first of equal clocks only; what the
    pieces leave has distinct clocks, so survivors tells what the fold over all of them would leave.
    """
    keys, columns = list(keys), df.columns
    one = first_of_equal(df, keys, clock, order)
    many = one.groupBy(*keys).agg(F.count("*").alias("__n"))
    dealt = one.join(many, keys).withColumn("__piece", F.pmod(F.xxhash64("__c"), F.ceil(F.col("__n") / PIECE)))
    version = F.struct(F.map_from_entries("__c").alias("clock"), F.struct(*order).alias("o"), F.struct(*[c for c in columns if c not in keys]).alias("r"))
    held = dealt.groupBy(*keys, "__piece").agg(F.collect_list(version).alias("v"))
    places = F.array_sort(F.transform("v", lambda x, i: F.struct(x["o"].alias("o"), i.alias("i"))))
    ordered = F.transform(places, lambda p: F.get("v", p["i"]))
    left = held.withColumn("o", ordered).select(*keys, F.explode(merge_siblings(F.slice("o", 1, 0), F.col("o"))).alias("x"))
    return survivors(left.select(*keys, "x.r.*"), keys, clock, order).select(*columns)


def context(df: DataFrame, keys: Sequence[str] = ("key",), clock: str = "clock") -> DataFrame:
    """keys and context: the elementwise maximum over all siblings, tombstones too."""
    each = df.select(*keys, F.explode_outer(clocks.normalised(F.col(clock))).alias("node", "counter")).groupBy(*keys, "node").agg(F.max("counter").alias("counter"))
    entries = F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "counter")))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("context"))


def live(df: DataFrame, keys: Sequence[str] = ("key",), value: str = "value_json", deleted: str = "is_deleted", clock: str = "clock", order: str = "seq") -> DataFrame:
    """For each key of resolved versions: its live values in order, found, and the context of all."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(deleted).alias("d"), F.col(value).alias("v")))), lambda x: ~x["d"])
    values = df.groupBy(*keys).agg(F.transform(kept, lambda x: x["v"]).alias("values"))
    return values.withColumn("found", F.size("values") > 0).join(context(df, keys, clock), list(keys))


def put(existing: DataFrame, writes: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The version that each write makes: writes has key, value_json, context (null: all that exists), node, is_deleted.

    A delete of a key without versions makes none.
    """
    known = context(existing, keys).withColumnRenamed("context", "__known")
    joined = writes.join(known, list(keys), "left").filter(~F.col("is_deleted") | F.col("__known").isNotNull())
    base = F.coalesce("context", "__known", F.expr("cast(map() as map<string,bigint>)"))
    return joined.select(*keys, "value_json", clocks.next_clock(base, F.col("node")).alias("clock"), F.substring_index("node", "#", 1).alias("last_updated_by"), "is_deleted")


def after_restore(df: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq", restore: str = "is_restore") -> DataFrame:
    """A change log without what the last restore of each key has replaced."""
    at = df.groupBy(*keys).agg(F.max(F.when(F.col(restore), F.col(seq))).alias("__at"))
    return df.join(at, list(keys)).filter(F.col("__at").isNull() | (F.col(seq) >= F.col("__at"))).drop("__at")


def replay(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """State after a log of puts and restores, in its order."""
    return survivors(after_restore(log, keys), keys)


def missing_from(have: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("key",), clock: str = "clock") -> DataFrame:
    """The rows of incoming whose clocks nothing in have covers, equal rows of incoming included."""
    other = have.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(clock).alias("__have"))
    same = None
    for k in keys:
        one = F.col(k) == F.col(f"__k_{k}")
        same = one if same is None else same & one
    return incoming.join(other, same & clocks.covers(F.col("__have"), F.col(clock)), "left_anti")


def tombstoned(resolved: DataFrame, keys: Sequence[str] = ("key",), deleted: str = "is_deleted") -> DataFrame:
    return resolved.groupBy(*keys).agg(F.bool_and(deleted).alias("__all"), F.count("*").alias("n")).filter("__all").drop("__all")


def newest_first(df: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """df with ord: 0 for a key's newest sibling."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1)


def oldest_first(df: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """df with ord: 0 for a key's oldest sibling."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
