"""Fault prediction and checking: expected outcomes, timelines, phases, buckets, read-backs, the report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions.sizes import if_small
from quorumlens.operators.placement import owners_of

SECOND = 1_000_000_000
VIOLATIONS = ["unexpected-success", "unexpected-failure", "stale-read"]
LISTED, EXAMPLES = 50, 5


@dataclass(frozen=True)
class Topology:
    """Members with zones, the quorum, and the timing in ns that says when a fault is noticed and over."""

    zones: dict[str, str]
    n: int = 3
    w: int = 2
    r: int = 2
    detection: int = 3_500_000_000
    recovery: int = 7_500_000_000

    def __post_init__(self):
        if not (1 <= self.w <= self.n and 1 <= self.r <= self.n and self.n <= len(self.zones)):
            raise ValueError("quorums must be from 1 to n, and n at most the number of members")

    @property
    def pods(self) -> list[str]:
        return sorted(self.zones)

    def zone_pods(self) -> dict[str, list[str]]:
        return {z: [p for p in self.pods if self.zones[p] == z] for z in sorted(set(self.zones.values()))}

    def standard_faults(self) -> list[tuple[str, list[str]]]:
        """Each member down, each zone down, each zone cut off; a zone of all members is left out."""
        some = [p for p in self.zone_pods().values() if len(p) < len(self.pods)]
        return [("down", [p]) for p in self.pods] + [("down", p) for p in some] + [("partition", p) for p in some]

    def sides(self, kind: str, pods: Sequence[str]) -> list[tuple[str, str]]:
        """Each side of a fault with its first member (empty: none)."""
        group = next((p for p in self.pods if p in pods), "")
        rest = next((p for p in self.pods if p not in pods), "")
        return [("group", group), ("rest", rest)] if kind == "partition" else [("live", rest)]


def parse_fault(spec: str, topology: Topology) -> tuple[str, list[str]]:
    """none, down:PODS, zone:ZONE, partition:PODS or partition-zone:ZONE."""
    kind, _, rest = spec.partition(":")
    if spec == "none":
        return "none", []
    if kind in ("zone", "partition-zone"):
        pods = topology.zone_pods().get(rest, [])
        kind = "down" if kind == "zone" else "partition"
        if not pods:
            raise ValueError(f"fault {spec!r}: no such zone")
    else:
        pods = rest.split(",")
    if kind not in ("down", "partition") or not all(pods) or set(pods) - set(topology.pods):
        raise ValueError(f"fault {spec!r}")
    pods = sorted(set(pods))
    if kind == "partition" and len(pods) == len(topology.pods):
        raise ValueError(f"fault {spec!r}: nothing is on the other side")
    return kind, pods


def expected(kind: Column, pods: Column, op: Column, owners: Column, target: Column, t: Topology) -> Column:
    """ok, fail, target-down or unknowable; a target that is no member is the empty string."""
    need = F.when(op == "get", t.r).otherwise(t.w)
    inside = F.size(F.array_intersect(owners, pods))
    outside = F.size(owners) - inside
    outcome = lambda n: F.when(n >= need, "ok").otherwise("fail")
    hit = F.array_contains(pods, target)
    down = F.when((target != "") & hit, "target-down").otherwise(outcome(outside))
    cut = F.when(target == "", F.when(outcome(inside) == outcome(outside), outcome(inside)).otherwise("unknowable")).when(hit, outcome(inside)).otherwise(outcome(outside))
    return F.when(kind == "down", down).when(kind == "partition", cut).otherwise("ok")


def unreachable(kind: Column, pods: Column, owners: Column, target: Column) -> Column:
    """How many owners the coordinator can't reach; -1 where its side isn't known."""
    inside = F.size(F.array_intersect(owners, pods))
    cut = F.when(target == "", -1).when(F.array_contains(pods, target), F.size(owners) - inside).otherwise(inside)
    return F.when(kind == "down", inside).when(kind == "partition", cut).otherwise(0)


def faults_frame(spark, topology: Topology, faults: Sequence[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(fault, kind, pods, side, target): a row for each side of each fault."""
    rows = [(f"{k}:{','.join(p)}" if k != "none" else k, k, p, s, t) for k, p in (faults or topology.standard_faults()) for s, t in topology.sides(k, p)]
    return spark.createDataFrame(rows, "fault string, kind string, pods array<string>, side string, target string")


def predictions(placed: DataFrame, faults: DataFrame, t: Topology) -> DataFrame:
    """placed (key, owners) by fault, side and op, with expect: a few rows of faults for each key."""
    ops = F.explode(F.array(F.lit("put"), F.lit("get")))
    each = placed.crossJoin(if_small(faults)).withColumn("op", ops)
    return each.withColumn("expect", expected(F.col("kind"), F.col("pods"), F.col("op"), F.col("owners"), F.col("target"), t))


def summary(placed: DataFrame, faults: DataFrame, t: Topology) -> DataFrame:
    """(fault, side, op, fails, keys): keys that are not ok from a side, and from no side (side 'nowhere').

    Owners repeat: keys are first counted by their owners, so the product with the faults has a row for each distinct list.
    """
    lists = placed.groupBy("owners").agg(F.count("*").alias("n"))
    each = predictions(lists, faults, t).withColumn("bad", F.col("expect") != "ok")
    by_side = each.groupBy("fault", "side", "op").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("fails"), F.sum("n").alias("keys"))
    nowhere = each.groupBy("fault", "op", "owners", "n").agg(F.bool_and("bad").alias("bad")).groupBy("fault", "op").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("fails"), F.sum("n").alias("keys"))
    return by_side.unionByName(nowhere.withColumn("side", F.lit("nowhere")))


def timelines(events: DataFrame, topology: Topology, tolerance: int, detection: int | None = None, recovery: int | None = None) -> DataFrame:
    """A row for each test of events (test, event, fault, mark, time_ns): its fault, windows, and when each member was back.

    Marks serving-POD count once each, the first in time; the plain serving mark before the heal opens the last window.
    """
    d, r = topology.detection if detection is None else detection, topology.recovery if recovery is None else recovery
    pod = F.when(F.col("event") == "mark", F.regexp_extract("mark", "^serving-(.+)$", 1))
    backs = events.withColumn("pod", pod).filter("pod <> ''").groupBy("test", "pod").agg(F.min("time_ns").alias("at"))
    backs = backs.groupBy("test").agg(F.array_sort(F.collect_list(F.struct("pod", "at"))).alias("backs"))
    at = lambda event: F.min(F.when(F.col("event") == event, F.col("time_ns")))
    one = events.groupBy("test").agg(
        F.max(F.when(F.col("event") == "inject", F.col("fault"))).alias("fault"), at("inject").alias("inject"), at("heal").alias("heal"),
        F.min(F.when((F.col("event") == "mark") & (F.col("mark") == "serving"), F.col("time_ns"))).alias("serving"),
    )
    one = one.join(backs, "test", "left").withColumn("backs", F.coalesce("backs", F.expr("cast(array() as array<struct<pod:string,at:bigint>>)")))
    zones = F.create_map(*[x for z, p in topology.zone_pods().items() for x in (F.lit(z), F.array(*map(F.lit, p)))])
    rest = F.get(F.split("fault", ":", 2), F.lit(1))
    head = F.split("fault", ":", 2)[0]
    pods = F.when(head.isin("zone", "partition-zone"), zones[rest]).otherwise(F.array_sort(F.array_distinct(F.split(F.coalesce(rest, F.lit("")), ","))))
    kind = F.when(head == "zone", "down").when(head == "partition-zone", "partition").otherwise(head)
    return one.withColumns({
        "kind": kind, "pods": F.coalesce(pods, F.array().cast("array<string>")),
        "in_from": F.col("inject") - tolerance, "in_to": F.col("inject") + d + tolerance,
        "out_from": F.when(F.col("heal").isNotNull(), F.least("heal", F.coalesce("serving", "heal")) - tolerance), "out_to": F.col("heal") + r + tolerance,
        "back_windows": F.transform("backs", lambda b: F.struct((b["at"] - tolerance).alias("from"), (b["at"] + r + tolerance).alias("to"))),
    })


def known_fault(fault: Column, t: Topology) -> Column:
    """Whether a spec is a fault of this topology: of its members or zones, and a partition with something on the other side."""
    head, rest = F.split(fault, ":", 2)[0], F.coalesce(F.get(F.split(fault, ":", 2), F.lit(1)), F.lit(""))
    pods = F.array_distinct(F.split(rest, ","))
    members = F.forall(pods, lambda p: p.isin(t.pods)) & ((head == "down") | (F.size(pods) < len(t.pods)))
    parts = [z for z, p in t.zone_pods().items() if len(p) < len(t.pods)]
    named = F.when(head == "zone", rest.isin(sorted(set(t.zones.values())))).when(head == "partition-zone", rest.isin(parts or [""]))
    return F.coalesce((fault == "none") | F.when(head.isin("down", "partition"), members).otherwise(named), F.lit(False))


def timeline_errors(events: DataFrame, topology: Topology | None = None) -> DataFrame:
    """(test, error) of timelines that can't be judged; with a topology, faults that it doesn't know and marks of members that aren't down too."""
    count = lambda event: F.count_if(F.col("event") == event)
    at = lambda event: F.min(F.when(F.col("event") == event, F.col("time_ns")))
    odd = ~F.col("event").isin("inject", "mark", "heal")
    nameless = (F.col("event") == "mark") & (F.coalesce("mark", F.lit("")) == "")
    by = events.groupBy("test").agg(count("inject").alias("injects"), count("heal").alias("heals"), at("inject").alias("i"), at("heal").alias("h"), F.count_if(odd).alias("odd"), F.count_if(nameless).alias("nameless"))
    named = {"injected twice": F.col("injects") > 1, "healed twice": F.col("heals") > 1, "never injected": F.col("injects") == 0, "healed before it was injected": F.col("h") < F.col("i"), "unknown event": F.col("odd") > 0, "a mark without a name": F.col("nameless") > 0}
    out = by.select("test", F.explode(F.filter(F.array(*[F.when(c, e) for e, c in named.items()]), lambda x: x.isNotNull())).alias("error"))
    if topology is None:
        return out
    faults = events.filter("event = 'inject'").select("test", "fault").distinct()
    unknown = faults.filter(~known_fault(F.coalesce("fault", F.lit("")), topology)).select("test", F.lit("unknown fault").alias("error")).distinct()
    zones = F.create_map(*[x for z, p in topology.zone_pods().items() for x in (F.lit(z), F.array(*map(F.lit, p)))])
    head, rest = F.split("fault", ":", 2)[0], F.get(F.split("fault", ":", 2), F.lit(1))
    down = F.when(head == "zone", zones[rest]).when(head == "down", F.split(rest, ","))
    marks = events.filter("event = 'mark'").select("test", F.regexp_extract("mark", "^serving-(.+)$", 1).alias("pod")).filter("pod <> ''").distinct()
    stray = marks.join(faults.filter(known_fault(F.coalesce("fault", F.lit("")), topology)), "test").filter(~F.coalesce(F.array_contains(down, F.col("pod")), F.lit(False)))
    return out.unionByName(unknown).unionByName(stray.select("test", F.lit("a mark of a member that is not down").alias("error")).distinct())


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start <= hi) & (end >= lo)


def phased(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """requests with their test's timeline (a row for each test), phase, and the fault in force when each began."""
    marked = requests.join(if_small(lines.withColumn("judged", F.lit(True))), "test", "left")
    start, end = F.col("start"), F.col("end")
    hit = overlaps(start, end, F.col("in_from"), F.col("in_to")) | F.coalesce(overlaps(start, end, F.col("out_from"), F.col("out_to")), F.lit(False)) | F.coalesce(F.exists("back_windows", lambda w: overlaps(start, end, w["from"], w["to"])), F.lit(False))
    during = (start > F.col("inject")) & (F.col("heal").isNull() | (end < F.col("heal")))
    phase = F.when(F.col("judged").isNull(), "normal").when(hit, "transition").when(during, "fault").otherwise("normal")
    left = F.filter("pods", lambda p: ~F.exists("backs", lambda b: (b["pod"] == p) & (start >= b["at"])))
    some = F.size("backs") > 0
    now_pods = F.when(some, left).otherwise(F.col("pods"))
    now_kind = F.when(some, F.when(F.size(left) == 0, "none").otherwise("down")).otherwise(F.col("kind"))
    return marked.withColumns({"phase": phase, "now_kind": F.coalesce(now_kind, F.lit("none")), "now_pods": F.coalesce(now_pods, F.array().cast("array<string>"))})


def first_acks(requests: DataFrame) -> DataFrame:
    return requests.filter("op = 'put' and result = 'ok'").groupBy("key").agg(F.min("end").alias("acked_end"))


def judged(requests: DataFrame, lines: DataFrame, t: Topology) -> DataFrame:
    """requests with phase, bucket, expect, n_unreachable, expected_under and the hint counts each adds."""
    both = phased(requests, lines).join(first_acks(requests), "key", "left")
    placed = owners_of(both, t.pods, t.n)
    pods = F.lit(t.pods)
    to = F.when(F.array_contains(pods, F.col("target")), F.col("target")).otherwise("")
    both = placed.withColumn("to", F.coalesce(to, F.lit("")))
    expect = F.when(F.col("phase") == "fault", expected(F.col("now_kind"), F.col("now_pods"), F.col("op"), F.col("owners"), F.col("to"), t)).otherwise("ok")
    both = both.withColumns({"expect": expect, "n_unreachable": unreachable(F.col("now_kind"), F.col("now_pods"), F.col("owners"), F.col("to"))})
    answered = ~F.col("result").isin("failed", "unknown")
    missed = (F.col("op") == "get") & F.col("result").isin("notfound", "mismatch")
    bucket = (
        F.when(F.col("result") == "dropped", "dropped")
        .when(missed & F.coalesce(F.col("acked_end") < F.col("start"), F.lit(False)), "stale-read")
        .when((F.col("op") == "get") & (F.col("result") == "notfound"), "unjudged-read")
        .when(F.col("phase") == "transition", "transition")
        .when((F.col("expect") == "fail") & answered, "unexpected-success")
        .when((F.col("expect") == "target-down") & answered, "target-down-ok")
        .when(F.col("expect") == "unknowable", "unknowable")
        .when((F.col("expect") == "ok") & ~answered, F.when(F.col("to") == "", "service-failure").otherwise("unexpected-failure"))
        .otherwise("as-predicted")
    )
    acked = (F.col("op") == "put") & (F.col("result") == "ok") & F.col("judged").isNotNull()
    n = F.col("n_unreachable")
    entering = overlaps(F.col("start"), F.col("end"), F.col("in_from"), F.col("in_to"))
    return both.withColumns({
        "bucket": bucket,
        "hints": F.when(acked & (F.col("phase") == "fault") & (n >= 0), n).otherwise(0),
        "hints_unknown": F.when(acked & (F.col("phase") == "fault") & (n < 0), 1).otherwise(0),
        "hints_maybe": F.when(acked & (F.col("phase") == "transition") & (n > 0), n).otherwise(0),
        "expected_under": F.coalesce(acked & (F.col("phase") == "transition") & (n != 0) & entering, F.lit(False)),
    })


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test", "bucket").agg(F.count("*").alias("n"))


def phase_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test", "phase", "op", "result").agg(F.count("*").alias("n"))


def hint_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("test").agg(F.sum("hints").alias("hints"), F.sum("hints_maybe").alias("hints_maybe"), F.sum("hints_unknown").alias("hints_unknown"), F.count_if("expected_under").alias("under_replicated"))


def examples(rows: DataFrame, n: int = EXAMPLES, order: str = "seq") -> DataFrame:
    """The first n requests of each test and bucket but the unremarkable ones: a top-n that each task cuts first."""
    odd = rows.filter(~F.col("bucket").isin("as-predicted", "dropped"))
    return odd.withColumn("place", F.row_number().over(Window.partitionBy("test", "bucket").orderBy(order))).filter(F.col("place") <= n)


def latest(readback: DataFrame, order: str = "pass") -> DataFrame:
    """Each key's last read-back by time; of equal times the later row."""
    rest = [c for c in readback.columns if c != "key"]
    return readback.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("time_ns", order)).alias("r")).select("key", "r.*")


def readback_report(requests: DataFrame, readback: DataFrame, expected_under: DataFrame, converged: bool = False, order: str = "pass") -> DataFrame:
    """One row of counters over acknowledged and unacknowledged writes; expected_under has the keys predicted to be short of copies."""
    acked = first_acks(requests)
    last = latest(readback, order).withColumn("seen", F.lit(True))
    under = expected_under.select("key").distinct().withColumn("allowed", F.lit(not converged))
    both = acked.join(last, "key", "left").join(under, "key", "left")
    short = F.coalesce((F.col("n_owners") > 0) & (F.col("n_holders") < F.col("n_owners")), F.lit(False))
    allowed = F.coalesce("allowed", F.lit(False))
    one = both.agg(
        F.count("*").alias("acked"), F.count_if(F.col("seen").isNull()).alias("not_read_back"),
        F.count_if(F.col("result").isin("notfound", "mismatch")).alias("lost"),
        F.count_if(F.col("seen").isNotNull() & ~F.col("result").isin("ok", "notfound", "mismatch")).alias("unreadable"),
        F.count_if(F.coalesce(F.col("n_owners") > 0, F.lit(False))).alias("copies_checked"), F.count_if(short).alias("under_replicated"),
        F.count_if(short & allowed).alias("under_replicated_expected"), F.count_if(short & ~allowed).alias("under_replicated_unexpected"),
    )
    unacked = requests.filter("op = 'put' and result in ('failed', 'unknown')").select("key").distinct().join(acked, "key", "left_anti").join(last, "key", "left")
    other = unacked.agg(F.count_if(F.col("result") == "ok").alias("unacked_present"), F.count_if(F.col("result") == "notfound").alias("unacked_absent"))
    return one.crossJoin(other)  # a row each


def listed(requests: DataFrame, readback: DataFrame, order: str = "pass", n: int = LISTED) -> DataFrame:
    """The first n lost keys in order, for the report."""
    return first_acks(requests).join(latest(readback, order).filter("result in ('notfound', 'mismatch')"), "key").select("key").orderBy("key").limit(n)


def short_of_copies(requests: DataFrame, readback: DataFrame, order: str = "pass", n: int = LISTED) -> DataFrame:
    """The first n acknowledged keys, in order, that fewer than all owners hold, for the report."""
    last = latest(readback, order).filter("n_owners > 0 and n_holders < n_owners")
    return first_acks(requests).join(last, "key").select("key", "n_owners", "n_holders").orderBy("key").limit(n)


def ordered_marks(events: DataFrame, order: str = "place") -> DataFrame:
    """Marks of each test numbered by time; equal times stay in their order."""
    w = Window.partitionBy("test").orderBy("time_ns", order)
    return events.filter("event = 'mark'").withColumn("number", F.row_number().over(w)).select("test", "mark", "number")


def verdict(rows: DataFrame, report: DataFrame) -> DataFrame:
    """One row: violations, and ok if there are none and nothing is lost, unread, unreadable or short of copies."""
    bad = rows.agg(F.count_if(F.col("bucket").isin(VIOLATIONS)).alias("violations"))
    fine = (F.col("violations") == 0) & (F.col("lost") == 0) & (F.col("not_read_back") == 0) & (F.col("unreadable") == 0) & (F.col("under_replicated_unexpected") == 0)
    return report.crossJoin(bad).select("violations", "lost", "not_read_back", "unreadable", "under_replicated_unexpected", fine.alias("ok"))


def offsets(events: DataFrame) -> DataFrame:
    """Marks and heals of each test as seconds after its injection."""
    inject = events.filter("event = 'inject'").groupBy("test").agg(F.min("time_ns").alias("inject"))
    later = events.filter("event <> 'inject'").join(if_small(inject), "test")
    return later.select("test", F.coalesce("mark", "event").alias("mark"), F.round((F.col("time_ns") - F.col("inject")) / SECOND, 1).alias("seconds"))
