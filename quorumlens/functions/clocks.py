"""Vector clocks as MAP<STRING, BIGINT>; a missing entry and a zero are the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUAL, BEFORE, AFTER, CONCURRENT = "equal", "before", "after", "concurrent"
COUNTERS = 1 << 32  # fixed value: counters are 32-bit


def normalised(clock: Column) -> Column:
    """Without zero entries."""
    return F.map_filter(F.coalesce(clock, F.expr("cast(map() as map<string,bigint>)")), lambda _, v: v > 0)


def canonical(clock: Column) -> Column:
    """Equal clocks have equal canonical arrays, which group, join and partition as maps do not."""
    return F.array_sort(F.map_entries(normalised(clock)))


def covers(a: Column, b: Column) -> Column:
    """a is equal to b or after it."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(a[e["key"]], F.lit(0)) >= e["value"])


def relation(a: Column, b: Column) -> Column:
    """How a stands to b."""
    up, down = covers(a, b), covers(b, a)
    return F.when(up & down, EQUAL).when(down, BEFORE).when(up, AFTER).otherwise(CONCURRENT)


def total(clock: Column) -> Column:
    return F.aggregate(F.map_values(clock), F.lit(0).cast("long"), lambda a, v: a + v)


def merged(a: Column, b: Column) -> Column:
    """Elementwise maximum of two clocks."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def union(clocks: Column) -> Column:
    """Elementwise maximum of an array of clocks, without zeros."""
    return normalised(F.aggregate(clocks, F.expr("cast(map() as map<string,bigint>)"), merged))


def next_clock(context: Column, writer: Column) -> Column:
    """The context with the writer's entry one up; raises beyond 32 bits, where a counter would wrap."""
    own = F.map_zip_with(context, F.create_map(writer, F.lit(1).cast("long")), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.when(own[writer] < COUNTERS, own).otherwise(F.raise_error("a clock counter exceeds 32 bits").cast("map<string,bigint>"))


def writer_id(node: Column, incarnation: Column) -> Column:
    return F.concat_ws("#", node, incarnation)


def from_counters(**columns: Column) -> Column:
    """A clock of fixed counter columns."""
    return normalised(F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[0]), kv[1]], columns.items(), [])))
