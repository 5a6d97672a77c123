"""Reconciliation of replicas: Merkle leaves and levels, divergent buckets, pulls and pushes, quorums, hints."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.functions import clocks
from quorumlens.functions.hashes import bucket_for
from quorumlens.operators.placement import owners_of, shares_replica
from quorumlens.operators.versions import missing_from, survivors
from quorumlens.sources.scratch import written

BUCKETS = 16


def item_text(value: Column, clock: Column, by: Column, deleted: Column) -> Column:
    """One version in the form that is hashed: fixed format, clock entries in order of node."""
    entries = F.array_join(F.transform(clocks.canonical(clock), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    return F.concat(F.lit("value="), value, F.lit("|vc={["), entries, F.lit("]}|by="), by, F.lit("|deleted="), deleted.cast("string"))


def leaves(versions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, hash) of a replica's resolved versions (key, item): SHA-256 of keys and item texts in order; empty buckets too.

    The hash of a bucket is defined over all its bytes in order of key and item, so its rows are sorted, which spills,
    and one task runs the hash over them row by row: no bucket is held. A tree for more keys takes more buckets.
    """
    if buckets <= 0 or buckets & (buckets - 1) or (buckets.bit_length() - 1) % 2:
        raise ValueError("the number of buckets must be a power of four")
    spark = versions.sparkSession

    def run(batches):
        at, key, digest = None, None, None
        for batch in batches:
            for bucket, own, item in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], names=["bucket", "hash"])
                    at, key, digest = bucket, None, hashlib.sha256()
                if own != key:
                    digest.update(own.encode() + b"\0")
                    key = own
                digest.update(item.encode() + b"\0")
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], names=["bucket", "hash"])

    rows = versions.select(bucket_for(F.col("key"), buckets).cast("int").alias("bucket"), "key", "item")
    hashed = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "item").mapInArrow(run, "bucket int, hash string")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(hashed, "bucket", "left").select("bucket", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("hash"))


def tree(leaf: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(node_index, hash) of all levels: node i has children 2i+1 and 2i+2, leaves come last.

    The leaves, a fixed number, become one array, and each level follows from the one below it in the same row.
    """
    level = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"])
    row, names, n = leaf.agg(level.alias(f"l{buckets}")), [f"l{buckets}"], buckets
    while n > 1:
        n //= 2
        row = row.withColumn(f"l{n}", _parents(F.col(names[-1]), n))
        names.append(f"l{n}")
    return row.select(F.posexplode(F.concat(*reversed(names))).alias("node_index", "hash"))


def _parents(level: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sha2(F.concat(F.unhex(level[2 * i]), F.unhex(level[2 * i + 1])), 256))


def divergent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose leaves differ."""
    return a.join(b.withColumnRenamed("hash", "other"), "bucket").filter("hash <> other").select("bucket")


def exchanged(local: DataFrame, remote: DataFrame, buckets: DataFrame, n: int = BUCKETS, shared: tuple[Sequence[str], int, str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What local pulls and pushes in the divergent buckets: versions that the other side doesn't cover.

    shared (members, copies, this node, the peer) keeps to the keys that both own: any other would get a copy that no read consults.
    """
    there = lambda df: df.withColumn("bucket", bucket_for(F.col("key"), n).cast("int")).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")  # noqa: E731  one row for each bucket at most
    if shared is not None:
        members, copies_, node, peer = shared
        both = lambda df: owners_of(df, members, copies_, to="__owners_of").filter(shares_replica(F.col("__owners_of"), F.lit(node), F.lit(peer))).drop("__owners_of")
        local, remote = both(local), both(remote)
    mine, theirs = there(local), there(remote)
    return missing_from(mine, theirs), missing_from(theirs, mine)


def reconciled(local: DataFrame, remote: DataFrame, n: int = BUCKETS, item: Column | None = None, shared: tuple[Sequence[str], int, str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both replicas after a round: each side's versions and what it got, resolved again.

    Replicas, and what they exchange, are read several times: each is written once.
    """
    local, remote = written(local, "local"), written(remote, "remote")
    told = lambda df: leaves(df.withColumn("item", item if item is not None else F.col("item")), n)
    pull, push = exchanged(local, remote, written(divergent(told(local), told(remote)), "divergent"), n, shared)
    return survivors(local.unionByName(written(pull, "pulled"))), survivors(remote.unionByName(written(push, "pushed")))


def quorum_read(responses: DataFrame, r: int, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Merge the versions of the first r replicas that answered: responses has rank (order of answers) with each version."""
    return survivors(responses.filter(F.col("rank") < r), keys, order=("rank", "seq"))


def write_outcome(owners: Column, down: Column, w: int) -> tuple[Column, Column]:
    """Acknowledgments that a write gets, and whether they reach w."""
    acks = F.size(F.array_except(owners, down))
    return acks, acks >= w


def hints(writes: DataFrame, unreachable: str = "unreachable") -> DataFrame:
    """A hint for each unreachable owner of an acknowledged write."""
    return writes.filter("result = 'ok'").withColumn("target", F.explode(unreachable))


def pending(hinted: DataFrame, delivered: DataFrame) -> DataFrame:
    """Hints (target, key, clock) that no delivery marker of their target and key covers."""
    return missing_from(delivered, hinted, ("target", "key"))


def copies(owners: DataFrame, replicas: DataFrame) -> DataFrame:
    """For each key of owners: who holds a copy, by an explode and a join with the replicas' keys (replica, key)."""
    each = owners.select("key", F.posexplode("owners").alias("place", "replica"))
    held = each.join(replicas.select("replica", "key").distinct().withColumn("held", F.lit(True)), ["replica", "key"], "left")
    order = F.array_sort(F.collect_list(F.when(F.col("held"), F.struct("place", "replica"))))
    return held.groupBy("key").agg(F.transform(order, lambda x: x["replica"]).alias("holders"), F.count("*").alias("n_owners"))
