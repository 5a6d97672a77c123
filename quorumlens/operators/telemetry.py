"""Telemetry: counters, histograms, quantiles, load steps, spread, detectors of change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions.sizes import if_small

# What a node reports of itself, with the label values of each.
NODE_METRICS = {
    "kv_membership_epoch": [""], "kv_membership_member": [""], "kv_membership_conflicts_total": [""], "kv_pings_received_total": [""],
    "kv_peers": [""], "kv_peers_alive": [""], "kv_peers_reachable": [""], "kv_quorum_failures_total": ["read", "write"],
    "kv_memtable_estimated_bytes": ["data", "hints"], "kv_sstables": ["data", "hints"], "kv_flushes_total": ["data ok", "data error", "hints ok", "hints error"],
    "kv_compactions_total": ["data ok", "data error", "hints ok", "hints error"], "kv_storage_writes_total": ["data", "hints"], "kv_storage_writes_halted": ["data", "hints"],
    "kv_hints_created_total": [""], "kv_hints_delivered_total": [""], "kv_hints_pending": [""],
    "kv_handoff_epoch": [""], "kv_handoff_done": [""], "kv_handoff_pushed": [""], "kv_handoff_hinted": [""], "kv_handoff_pending": [""],
    "kv_handoffs_completed_total": [""], "kv_handoff_last_duration_seconds": [""], "kv_handoff_duration_seconds_total": [""],
    "kv_antientropy_rounds_total": [""], "kv_antientropy_last_round_duration_seconds": [""], "kv_antientropy_round_duration_seconds_total": [""],
    "kv_antientropy_peer_failures_total": [""], "kv_antientropy_keys_repaired_total": ["pulled", "pushed"],
}
#: Metrics that are absent while what they depend on is 0: (metric, column that tells).
ABSENT_UNTIL = {"kv_hints_pending": "hint_rounds", "kv_handoff_last_duration_seconds": "handoffs_completed", "kv_antientropy_last_round_duration_seconds": "antientropy_rounds"}


def increases(samples: DataFrame, series: Sequence[str], time: str = "time_us", value: str = "counter_value", order: str = "sample") -> DataFrame:
    """samples with increase: the step from the series' last sample, a whole value after a reset, 0 for the first."""
    w = Window.partitionBy(*series).orderBy(time, order)
    before = F.lag(value).over(w)
    return samples.withColumn("increase", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before).cast("long"))


def total_increase(samples: DataFrame, series: Sequence[str], by: Sequence[str], **names: str) -> DataFrame:
    return increases(samples, series, **names).groupBy(*by).agg(F.sum("increase").alias("increase"), F.count("*").alias("samples"))


def rates(samples: DataFrame, series: Sequence[str], by: Sequence[str], step_us: int, **names: str) -> DataFrame:
    """Increase per second by label and time step, not extrapolated to the step's edges."""
    time = names.get("time", "time_us")
    each = increases(samples, series, **names).withColumn("step", F.floor(F.col(time) / step_us) * step_us)
    return each.groupBy(*by, "step").agg(F.sum("increase").alias("increase")).withColumn("rate", F.col("increase") / F.lit(step_us / 1e6))


def histogram(values: DataFrame, bounds: Sequence[float], value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts by upper bound le, the last infinite: one pass, a sum for each bound."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = values.groupBy(*by).agg(*sums, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n"))]
    return one.select(*by, F.explode(F.array(*pairs)).alias("x")).select(*by, "x.le", "x.n")


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """Linear interpolation in the bucket that holds the q-th part; the highest finite bound beyond; NaN if empty.

    at_top marks a quantile at the highest finite bound, which may be larger; least raises small quantiles.
    """
    w = Window.partitionBy(*[F.col(c) for c in by]).orderBy("le") if by else Window.partitionBy(F.lit(1)).orderBy("le")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = buckets.withColumns({"total": F.max("n").over(every), "below": F.coalesce(F.lag("n").over(w), F.lit(0)), "lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "top": F.max(F.when(F.col("le") < float("inf"), F.col("le"))).over(every)})
    rank = F.col("total") * F.lit(q)
    hit = rows.withColumn("rank", rank).filter((F.col("n") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("below") == 0)))
    inside = F.when(F.col("le") == float("inf"), F.col("top")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")))
    one = hit.groupBy(*by).agg(F.min_by(F.when(F.col("total") > 0, inside).otherwise(float("nan")), "le").alias("quantile"), F.max("top").alias("top"))
    value = F.greatest("quantile", F.lit(least)) if least is not None else F.col("quantile")
    return one.select(*by, value.alias("quantile"), (F.col("quantile") >= F.col("top")).alias("at_top"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def resampled(samples: DataFrame, series: Sequence[str], step_us: int, time: str = "time_us", value: str = "counter_value", order: str = "sample") -> DataFrame:
    """Each series' last value in each time step that has one."""
    step = (F.floor(F.col(time) / step_us) * step_us).cast("long")
    return samples.groupBy(*series, step.alias("step")).agg(F.max_by(value, F.struct(time, order)).alias("value"), F.count("*").alias("samples"))


def ramp_steps(stages: DataFrame, start_rate: float) -> DataFrame:
    """stages (place, rate, secs) as the held steps of a ramp: a stage holds if its rate is the one before; offsets run on."""
    w = Window.orderBy("place")
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    told = stages.withColumns({"before": F.coalesce(F.lag("rate").over(w), F.lit(float(start_rate))), "from_s": F.coalesce(F.sum("secs").over(run), F.lit(0))})
    held = told.filter("rate = before").withColumn("step", F.row_number().over(w))
    return held.select("step", F.col("rate").alias("target_rate"), F.col("from_s"), (F.col("from_s") + F.col("secs")).alias("to_s"))


def in_steps(iterations: DataFrame, steps: DataFrame, at: str = "at_s") -> DataFrame:
    """iterations with the step (half-open in seconds) that each began in; null between steps. steps are a few rows."""
    return iterations.join(if_small(steps), (F.col(at) >= F.col("from_s")) & (F.col(at) < F.col("to_s")), "left")


def step_stats(iterations: DataFrame, latency: str, ok: Column) -> DataFrame:
    """By step: target, started, achieved rate, latency quantiles of what succeeded, errors, and arrivals that didn't start."""
    good = F.when(ok, F.col(latency))
    by = iterations.filter("step is not null").groupBy("step", "target_rate", "from_s", "to_s")
    q = F.percentile(good, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    one = by.agg(F.count("*").alias("started"), F.count(good).alias("n"), q.alias("q"), F.max(good).alias("max_ms"), F.count_if(~ok).alias("errors"))
    secs = F.col("to_s") - F.col("from_s")
    dropped = F.greatest(F.lit(0).cast("long"), F.round(F.col("target_rate") * secs - F.col("started"), 0).cast("long"))
    return one.select("step", "target_rate", secs.alias("seconds"), "started", F.round(F.col("started") / secs, 1).alias("achieved_rate"), "n", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"), F.col("q")[2].alias("p99_ms"), "max_ms", "errors", dropped.alias("dropped"))


def spread(counts: DataFrame, n: str = "n") -> DataFrame:
    """Largest and smallest over the median of a few counts (one for each member)."""
    one = counts.agg(F.max(n).alias("hi"), F.min(n).alias("lo"), F.percentile(n, 0.5).alias("mid"))
    return one.select(ratio(F.col("hi"), F.col("mid")).alias("max_over_median"), ratio(F.col("lo"), F.col("mid")).alias("min_over_median"))


def knee(steps: DataFrame, factor: float = 2.0) -> DataFrame:
    """The first step whose p99 is factor times the one before, or that has errors or dropped arrivals."""
    before = F.lag("p99_ms").over(Window.orderBy("step"))
    bent = (F.col("p99_ms") >= before * factor) | (F.col("errors") > 0) | (F.col("dropped") > 0)
    return steps.withColumn("bent", F.coalesce(bent, F.lit(False))).filter("bent").agg(F.min("step").alias("step"))


def combined_pods(steps: DataFrame) -> DataFrame:
    """Rates and counts of several load generators added by step and op; quantiles don't add and stay with their pod."""
    return steps.groupBy("step", "op").agg(F.sum("target_rate").alias("target_rate"), F.sum("achieved_rate").alias("achieved_rate"), F.sum("count").alias("count"), F.sum("errors").alias("errors"), F.sum("dropped").alias("dropped"), F.max("p99_ms").alias("worst_p99_ms"))


def measured_window(steps: DataFrame, start: str = "start_s", secs: str = "seconds") -> DataFrame:
    return steps.agg(F.min(start).alias("from_s"), F.max(F.ceil(F.col(start) + F.col(secs))).alias("to_s"))


def valid_run(dropped: Column, cpu_used: Column, cpu_requested: Column, max_over_median: Column) -> Column:
    return (dropped == 0) & (cpu_used * 2 < cpu_requested) & (max_over_median <= 1.5)


def dead_spells(pings: DataFrame, misses: int = 3, by: Sequence[str] = ("observer", "peer"), order: str = "seq") -> DataFrame:
    """Runs of at least misses failed pings in a row (ok: boolean): the peer counts as dead from the misses-th on."""
    w = Window.partitionBy(*by).orderBy(order)
    run = pings.withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    missed = run.filter(~F.col("ok"))
    place = F.row_number().over(Window.partitionBy(*by, "island").orderBy(order))
    told = missed.withColumn("place", place).groupBy(*by, "island").agg(F.count("*").alias("missed"), F.min(F.when(F.col("place") == misses, F.col(order))).alias("dead_from"))
    return told.filter(F.col("missed") >= misses).drop("island")


def changes(statuses: DataFrame, by: Sequence[str], status: str = "status", order: str = "seq") -> DataFrame:
    """Rows whose status isn't that of the row before in their series."""
    before = F.lag(status).over(Window.partitionBy(*by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return statuses.withColumn("changed", first | ~before.eqNullSafe(F.col(status))).filter("changed").drop("changed")


def planned_writes(stages: DataFrame, start_rate: int, cap: int) -> DataFrame:
    """Arrivals that a ramp of moves and holds (place, rate, move, hold) plans: trapezoids in whole numbers, and whether a cap allows them."""
    before = F.coalesce(F.lag("rate").over(Window.orderBy("place")), F.lit(start_rate))
    each = stages.withColumn("writes", F.floor((before + F.col("rate")) * F.col("move") / 2) + F.col("rate") * F.col("hold"))
    return each.agg(F.sum("writes").alias("writes")).withColumn("allowed", F.col("writes") <= cap)


def snapshot_delta(snapshots: DataFrame) -> DataFrame:
    """Counters (test, when, pod, created, delivered) after a test less those before."""
    a, b = (snapshots.filter(F.col("when") == w) for w in ("after", "before"))
    both = a.alias("a").join(b.alias("b"), ["test", "pod"])
    return both.select("test", "pod", (F.col("a.created") - F.col("b.created")).alias("created"), (F.col("a.delivered") - F.col("b.delivered")).alias("delivered"))


def long_metrics(stats: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row for each metric of a wide snapshot that is known (not null)."""
    names = [c for c in stats.columns if c not in labels]
    return stats.select(*labels, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(labels), names, "metric", "value").filter("value is not null")


def node_snapshot(stats: DataFrame, of, labels: Sequence[str] = ("instance",)) -> DataFrame:
    """(labels, metric, label, value) of snapshots, a row each: of(metric, label) gives the column that a metric's value comes from.

    A metric of what has not happened yet is absent, not 0.
    """
    known = lambda m: F.col(ABSENT_UNTIL[m]) > 0 if m in ABSENT_UNTIL else F.lit(True)
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(x).alias("label"), F.when(known(m), of(m, x)).cast("double").alias("value")) for m, all_ in NODE_METRICS.items() for x in all_]
    return stats.select(*labels, F.explode(F.array(*rows)).alias("r")).select(*labels, "r.*").filter("value is not null")


def around(samples: DataFrame, marks: DataFrame, series: Sequence[str], *, before_s: int = 60, after_s: int = 30, step_s: int = 15, lookback_s: int = 300, time: str = "time_us", value: str = "counter_value", order: str = "sample") -> DataFrame:
    """(mark, series, offset_s, value) every step from before to after each mark (mark, at_us): the last sample no older than lookback.

    Samples meet the few points of time of their span of lookback on equality, so one pass over them does.
    """
    us = 1_000_000
    points = marks.select("mark", "at_us", F.explode(F.sequence(F.lit(-before_s), F.lit(after_s), F.lit(step_s))).alias("offset_s")).withColumn("t", F.col("at_us") + F.col("offset_s") * us)
    span = F.floor(F.col("t") / (lookback_s * us)).cast("long")
    points = points.withColumn("span", F.explode(F.array(span, span - 1)))
    met = samples.withColumn("span", F.floor(F.col(time) / (lookback_s * us)).cast("long")).join(if_small(points), "span")
    met = met.filter((F.col(time) <= F.col("t")) & (F.col(time) > F.col("t") - lookback_s * us))
    return met.groupBy("mark", *series, "offset_s").agg(F.max_by(value, F.struct(time, order)).alias("value"))


def arrivals(stages: DataFrame, start_rate: float) -> DataFrame:
    """(place, second, arrivals) that a ramp of moves and holds (place, rate, move, hold) plans, a row for each second of each stage."""
    before = F.coalesce(F.lag("rate").over(Window.orderBy("place")), F.lit(start_rate)).cast("double")
    told = stages.withColumn("before", before).withColumn("second", F.explode(F.sequence(F.lit(0), F.col("move") + F.col("hold") - 1)))

    def until(t: Column) -> Column:
        moving = F.least(t, F.col("move")).cast("double")
        held = F.greatest(t - F.col("move"), F.lit(0)).cast("double")
        return F.floor(F.col("before") * moving + (F.col("rate") - F.col("before")) * moving * moving / (2 * F.col("move")) + F.col("rate") * held)

    return told.select("place", "second", (until(F.col("second") + 1) - until(F.col("second"))).alias("arrivals"))


def run_totals(runs: DataFrame, cpu: str = "cpu") -> DataFrame:
    """Several load generators as one row: sums of what was dropped, failed and connected, the largest CPU share and the middle one by position."""
    ordered = F.array_sort(F.collect_list(cpu))  # a row for each generator
    one = runs.agg(F.sum("dropped").alias("dropped"), F.sum("errors").alias("errors"), F.sum("connects").alias("connects"), ordered.alias("c"))
    return one.select("dropped", "errors", "connects", F.element_at("c", -1).alias("cpu_max"), F.get("c", (F.floor((F.size("c") + 1) / 2) - 1).cast("int")).alias("cpu_median"))
