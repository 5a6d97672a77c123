"""Rounds of a member as transitions of tables: hints delivered, data handed off, peers reconciled in turn, reads that fail."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions.sizes import if_small
from quorumlens.operators.versions import survivors

# The codes after which a round tries no further hint of a target.
STOPS = ["Unavailable", "DeadlineExceeded"]


def delivered(hints: DataFrame, members: Sequence[str], dead: Sequence[str] = (), code: str = "code", order: str = "seq") -> DataFrame:
    """hints (target, code: what their delivery would answer, null for success) with the outcome of one round.

    A target that is no member or is dead is skipped. Hints go out in order until one finds the target unavailable:
    that and other errors are kept for the next round, and what comes after it isn't tried. Only a row for each
    target, the place where its turn ends, is joined back, so a target with very many hints is no single task.
    """
    skip = ~F.col("target").isin(list(members)) | F.col("target").isin(list(dead) or [""])
    stops = hints.filter(F.col(code).isin(STOPS)).groupBy("target").agg(F.min(order).alias("__stop"))
    both = hints.join(if_small(stops), "target", "left")
    late = F.coalesce(F.col(order) > F.col("__stop"), F.lit(False))
    outcome = F.when(skip, "skipped").when(late, "not tried").when(F.col(code).isNotNull(), "kept").otherwise("delivered")
    return both.withColumn("outcome", outcome).drop("__stop")


def handed_off(pushes: DataFrame, stays: Column, accepted: Column) -> DataFrame:
    """pushes (key, source, target) with outcome: pushed, hinted (the source stays and keeps a hint) or retried (it leaves)."""
    return pushes.withColumn("outcome", F.when(accepted, "pushed").when(stays, "hinted").otherwise("retried"))


def handoff_status(outcomes: DataFrame) -> DataFrame:
    """By source: pushes that succeeded, pushes that became hints, keys still to be handled, and whether the handoff is done."""
    by_key = outcomes.groupBy("source", "key").agg(F.count_if(F.col("outcome") == "pushed").alias("pushed"), F.count_if(F.col("outcome") == "hinted").alias("hinted"), F.count_if(F.col("outcome") == "retried").alias("retried"))
    by = by_key.groupBy("source").agg(F.sum("pushed").alias("pushed"), F.sum("hinted").alias("hinted"), F.count_if(F.col("retried") > 0).alias("pending"))
    return by.withColumn("done", F.col("pending") == 0)


def handoff_bases(views: DataFrame, node: str = "node", order: str = "seq") -> DataFrame:
    """views (epoch, completed: whether the handoff to it ran to its end) with the base it starts from, and whether a newer view took its place.

    The base moves only to a view whose handoff completed; a view no newer than the base starts none.
    """
    w = Window.partitionBy(node).orderBy(order)
    base = F.coalesce(F.max(F.when(F.col("completed"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    later = F.lead("epoch").over(w)
    out = views.withColumns({"base": base, "later": later})
    return out.withColumns({"started": F.col("epoch") > F.col("base"), "superseded": ~F.col("completed") & F.coalesce(F.col("later") > F.col("epoch"), F.lit(False))}).drop("later")


def turns(members: DataFrame, dead: Sequence[str] = ()) -> DataFrame:
    """(node, peer, turn): whom each of members (id, node's own row left out) reconciles with in a round, dead ones skipped, in order of id.

    A row for each pair of members: their number is a cluster's, not the data's.
    """
    a, b = members.select(F.col("id").alias("node")), members.select(F.col("id").alias("peer"))
    pairs = a.join(if_small(b), F.col("node") != F.col("peer")).filter(~F.col("peer").isin(list(dead) or [""]))
    return pairs.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("peer")))


def read_outcomes(answers: DataFrame, r: int) -> DataFrame:
    """By key of answers (key, rank: order of answering, ok): ok if r replicas answered, and responses counted when that was settled.

    A local error and a dead peer are failed votes like any other; the read fails once the rest can't make r.
    """
    w = Window.partitionBy("key").orderBy("rank")
    n = Window.partitionBy("key")
    each = answers.withColumns({"good": F.sum(F.col("ok").cast("int")).over(w), "bad": F.sum((~F.col("ok")).cast("int")).over(w), "n": F.count("*").over(n)})
    settled = (F.col("good") >= r) | (F.col("n") - F.col("bad") < r)
    first = F.min_by("good", F.when(settled, F.col("rank")))
    out = each.groupBy("key").agg((F.max("good") >= r).alias("ok"), first.alias("responses"), F.max("n").alias("n"))
    return out.select("key", "ok", F.coalesce("responses", F.lit(0)).cast("long").alias("responses"))


def quorum_reads(versions: DataFrame, answers: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
    """The outcomes, and for keys read successfully the versions (key, rank, ...) of the first r replicas that answered, merged."""
    outcomes = read_outcomes(answers, r)
    w = Window.partitionBy("key").orderBy("rank")
    first = answers.filter("ok").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= r)
    used = first.join(outcomes.filter("ok").select("key"), "key", "left_semi").select("key", "rank")
    return outcomes, survivors(versions.join(used, ["key", "rank"], "left_semi"), order=("rank", "seq"))


def unreachable_since(observations: DataFrame, pod: str = "uid", order: str = "seq", now: str = "now") -> DataFrame:
    """observations (answered) with since: when the pod stopped answering, null while it answers."""
    island = F.sum(F.col("answered").cast("int")).over(Window.partitionBy(pod).orderBy(order))
    run = observations.withColumn("__island", F.coalesce(island, F.lit(0)))
    since = F.min(F.when(~F.col("answered"), F.col(now))).over(Window.partitionBy(pod, "__island").orderBy(order))
    return run.withColumn("since", F.when(~F.col("answered"), since)).drop("__island")


def latched(writes: DataFrame, failed: Column, by: Sequence[str] = ("engine",), order: str = "seq") -> DataFrame:
    """writes with outcome: failed at an engine's first storage failure, halted for everything after it, else durable."""
    first = writes.filter(failed).groupBy(*by).agg(F.min(order).alias("__first"))
    both = writes.join(if_small(first), list(by), "left")
    outcome = F.when(F.col(order) > F.col("__first"), "halted").when(F.col(order) == F.col("__first"), "failed").otherwise("durable")
    return both.withColumn("outcome", outcome).drop("__first")


def replicated(items: DataFrame, by: Sequence[str] = ("batch",), order: str = "seq") -> DataFrame:
    """By batch of items (code: null where an item would be stored): how many are, in order, before the first that isn't, and its code.

    What was stored stays; the batch answers with the code of its first failure, Unavailable only where writes are halted.
    """
    first = F.min_by("code", F.when(F.col("code").isNotNull(), F.col(order)))
    at = F.min(F.when(F.col("code").isNotNull(), F.col(order)))
    ends = items.groupBy(*by).agg(at.alias("__at"), first.alias("answer"))
    both = items.join(ends, list(by))
    return both.groupBy(*by, "answer").agg(F.count_if(F.col("__at").isNull() | (F.col(order) < F.col("__at"))).alias("stored"))


# The codes after which a write is forwarded to the next owner.
PASSED_ON = ["Dead", "Undialable", "Unavailable", "FailedPrecondition"]


def forwarded(owners: Column, code_of) -> tuple[Column, Column, Column]:
    """Which owner answers a forwarded write, in order of preference, its code (null: accepted), and how many were tried; code_of(owner) gives each one's."""
    each = F.transform(owners, lambda o: F.struct(o.alias("owner"), code_of(o).alias("code")))
    ends = F.filter(each, lambda x: ~F.coalesce(x["code"].isin(PASSED_ON), F.lit(False)))
    answer = F.get(ends, F.lit(0))
    tried = F.when(answer.isNull(), F.size(owners)).otherwise(F.array_position(owners, answer["owner"]).cast("int"))
    return answer["owner"], F.when(answer.isNull(), "Unavailable").otherwise(answer["code"]), tried


def ping_backs(pings: DataFrame, by: Sequence[str] = ("observer", "peer"), order: str = "seq") -> DataFrame:
    """Inbound pings (kind in) of peers whose last outbound ping (kind out, ok) failed: each is answered by a ping at once."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "out", F.col("ok")), ignorenulls=True).over(w)
    return pings.withColumn("__last", last).filter((F.col("kind") == "in") & ~F.coalesce("__last", F.lit(True))).drop("__last")


def group_commits(writes: DataFrame, by: str = "engine", order: str = "seq", size: str = "bytes", max_records: int = 1000, max_bytes: int = 1 << 20) -> DataFrame:
    """writes (engine, seq, bytes), all queued, as the batches that one sync each makes durable: (engine, batch, records, bytes).

    A batch takes the next records in order while there are at most max_records of max_bytes together, and one at least.
    Rows are sorted, which spills, and one pass over each engine's log, which is sequential, holds no more than a batch's sums.
    """

    def run(batches):
        at, number, n, total, out = None, 0, 0, 0, []
        for rows in batches:
            for engine, more in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if n and (engine != at or n == max_records or total + more > max_bytes):
                    out.append((at, number, n, total))
                    number, n, total = number + 1, 0, 0
                if engine != at:
                    at, number = engine, 0
                n, total = n + 1, total + more
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at, number, n, total), kinds, strict=True)], names=names)

    kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["engine", "batch", "records", "bytes"]
    given = writes.select(F.col(by).alias("engine"), F.col(size).cast("long").alias("bytes"), F.col(order).alias("__order"))
    dealt = given.repartition("engine").sortWithinPartitions("engine", "__order").select("engine", "bytes")
    return dealt.mapInArrow(run, "engine string, batch long, records long, bytes long")
