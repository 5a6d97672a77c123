"""Membership: epoch rules, census, gossip, and the planner of the next step as one CASE over an observation.

An observation row has cluster, namespace, now_s, desired, grace_s, drain_timeout_s, drain_started_s,
prev_phase, sts, cm, pods and pvcs (OBSERVATION). The decision is built of derived columns and one
ladder of conditions, so it runs inside the JVM over any number of observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlens.functions.hashes import fingerprint

MEMBERSHIP = "struct<epoch:bigint,members:map<string,string>,handoff_epoch:bigint,handoff_done:boolean>"
OBSERVATION = (
    "cluster string, namespace string, now_s long, desired int, grace_s long, drain_timeout_s long, drain_started_s long, prev_phase string, "
    "sts struct<replicas:int,ready:int,rolled_out:boolean,template_current:boolean>, cm struct<epoch:bigint,members:map<string,string>,invalid:string>, "
    f"pods array<struct<ordinal:int,present:boolean,terminating:boolean,ready:boolean,since_s:bigint,membership:{MEMBERSHIP},unreachable_since_s:bigint,drain:struct<epoch:bigint,drained:boolean,pending:int>>>, pvcs array<int>"
)


def entries(members: Column) -> Column:
    """A map in a form that compares."""
    return F.array_sort(F.map_entries(members))


def announced(df: DataFrame, node: str = "node", order: str = "seq") -> DataFrame:
    """Each announcement (epoch, fingerprint) with its effect on the node: adopted, no-op, stale or conflict."""
    before = Window.partitionBy(node).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.struct("epoch", (-F.col(order)).alias("o"), "fingerprint")).over(before)
    df = df.withColumn("__held", held)
    effect = F.when(F.col("__held").isNull() | (F.col("epoch") > F.col("__held.epoch")), "adopted").when(F.col("epoch") < F.col("__held.epoch"), "stale").when(F.col("fingerprint") == F.col("__held.fingerprint"), "no-op").otherwise("conflict")
    return df.withColumn("effect", effect).drop("__held")


def census(views: DataFrame) -> DataFrame:
    """Views (epoch, members) by epoch: how many hold it, how many member sets there are, and whether they conflict."""
    return views.groupBy("epoch").agg(F.count("*").alias("views"), F.count_distinct(F.to_json(entries(F.col("members")))).alias("member_sets")).withColumn("conflict", F.col("member_sets") > 1)


def gossip(views: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """Views (node, epoch) after rounds in which each node takes the highest epoch of itself and those it hears (node, hears)."""
    for _ in range(rounds):
        heard = links.join(views.select(F.col("node").alias("hears"), "epoch"), "hears").select("node", "epoch")
        views = views.unionByName(heard).groupBy("node").agg(F.max("epoch").alias("epoch"))
    return views


def drained(handoff_done: Column, is_member: Column, peer_epochs: Column, epoch: Column) -> Column:
    """Whether a member may stop: its handoff is done, and it's still a member or every peer has seen the epoch."""
    return handoff_done & (is_member | F.forall(peer_epochs, lambda e: e >= epoch))


def wanted(cluster: Column, namespace: Column, size: Column) -> Column:
    """The entries of the members 0 to size-1 as the operator writes them."""
    of = lambda i: F.struct(F.concat(cluster, F.lit("-"), i).alias("key"), F.concat(cluster, F.lit("-"), i, F.lit("."), cluster, F.lit("."), namespace, F.lit(".svc.cluster.local:7000")).alias("value"))
    return F.when(size > 0, F.array_sort(F.transform(F.sequence(F.lit(0), size - 1), of))).otherwise(F.filter(F.array(of(F.lit(0))), lambda _: F.lit(False)))


def written(cluster: Column, namespace: Column, members: Column) -> Column:
    """Whether every member is one that the operator writes: a pod's name with that pod's address."""
    tail = F.concat(F.lit("."), cluster, F.lit("."), namespace, F.lit(".svc.cluster.local:7000"))
    number = lambda k: F.substr(k, F.length(cluster) + 2)
    return F.forall(F.map_entries(members), lambda e: e["key"].startswith(F.concat(cluster, F.lit("-"))) & number(e["key"]).rlike("^(0|[1-9][0-9]*)$") & (e["value"] == F.concat(e["key"], tail)))


def plan(obs: DataFrame) -> DataFrame:
    """obs with the decision: action, phase, reason, to_epoch, to_size (members or replicas), drain_started."""
    c, ns, sts, cm, pods = (F.col(x) for x in ("cluster", "namespace", "sts", "cm", "pods"))
    s, size = sts["replicas"], F.size(cm["members"])
    own = F.filter(pods, lambda p: p["ordinal"] < s)
    views = F.filter(own, lambda p: p["membership"].isNotNull())
    d = obs.withColumns({"__s": s, "__c": size, "__ec": cm["epoch"], "__own": own, "__views": views})
    s, size, ec, own, views = (F.col(x) for x in ("__s", "__c", "__ec", "__own", "__views"))
    told = F.transform(views, lambda p: F.struct(p["membership"]["epoch"].alias("epoch"), entries(p["membership"]["members"]).alias("m")))
    d = d.withColumns({"__told": told, "__epochs": F.array_sort(F.array_distinct(F.transform(views, lambda p: p["membership"]["epoch"])))})
    told, epochs = F.col("__told"), F.col("__epochs")
    holds = lambda v, e, n: (v["epoch"] == e) & (v["m"] == wanted(c, ns, n))
    within = lambda *states: F.forall(told, lambda v: _any([holds(v, e, n) for e, n in states]))
    some = lambda e, n: F.exists(told, lambda v: holds(v, e, n))
    healthy = lambda p: p["present"] & ~p["terminating"] & p["ready"] & p["membership"].isNotNull()
    up = (F.size(own) == s) & F.forall(own, healthy)
    d = d.withColumns({
        "__clash": F.exists(told, lambda a: F.exists(told, lambda b: (a["epoch"] == b["epoch"]) & (a["m"] != b["m"]))),
        "__far": (F.size(epochs) > 2) | ((F.size(epochs) == 2) & (F.get(epochs, F.lit(1)) != F.get(epochs, F.lit(0)) + 1)),
        "__foreign": F.exists(views, lambda p: ~written(c, ns, p["membership"]["members"])),
        "__up": up,
    })
    step = (
        F.when(size == s + 1, F.when(within((ec, s + 1), (F.when(ec >= 1, ec - 1), s)), "grow"))
        .when(size == s, F.when(within((ec, s)), "settled").when((ec >= 1) & within((ec - 1, s - 1), (ec, s)) & some(ec - 1, s - 1), "joining").when(within((ec, s), (ec + 1, s - 1)) & some(ec + 1, s - 1), "draining"))
        .when(size == s - 1, F.when(within((ec, size)), "shrink"))
    )
    d = d.withColumn("__step", F.coalesce(step, F.lit("none")))
    exempt = F.when(F.col("__step").isin("draining", "shrink"), s - 1).otherwise(-1)
    since = lambda p: F.when(p["ready"], p["unreachable_since_s"]).otherwise(p["since_s"])
    late = F.exists(own, lambda p: (p["ordinal"] != exempt) & p["present"] & ~healthy(p) & F.coalesce(F.col("now_s") - since(p) > F.col("grace_s"), F.lit(False)))
    leaving = F.get(F.filter(pods, lambda p: p["ordinal"] == s - 1), F.lit(0))
    gone = F.coalesce((leaving["drain"]["epoch"] == ec + 1) & leaving["drain"]["drained"] & (leaving["membership"]["epoch"] == ec + 1), F.lit(False))
    waited = F.col("now_s") - F.coalesce("drain_started_s", "now_s")
    taken = F.exists(pods, lambda p: (p["ordinal"] == s) & p["present"]) | F.array_contains("pvcs", s)
    beyond = F.exists(pods, lambda p: (p["ordinal"] >= s) & p["present"])
    volumes = F.exists("pvcs", lambda i: i >= s)
    handing = F.exists(views, lambda p: (p["membership"]["handoff_epoch"] < ec) | ~p["membership"]["handoff_done"])
    rolling = ~sts["rolled_out"] | (sts["ready"] < s)
    calm = F.when(F.coalesce("prev_phase", F.lit("")).isin("Degraded", "DrainBlocked"), "Scaling").when(F.coalesce("prev_phase", F.lit("")) == "", "Pending").otherwise(F.col("prev_phase"))
    none = F.lit(None).cast("long")
    at = F.col("__step")
    # (condition, action, phase, reason, epoch, size): the first that holds decides
    ladder = [
        (cm.isNull() & sts.isNull(), "WriteConfigMap", "Pending", "CreatingConfigMap", F.lit(0), F.col("desired")),
        (cm.isNull(), "Wait", "Degraded", "ConfigMapMissing", none, none),
        (F.coalesce(cm["invalid"], F.lit("")) != "", "Wait", "Degraded", "ConfigMapUnexpected", none, none),
        (entries(cm["members"]) != wanted(c, ns, size), "Wait", "Degraded", "ConfigMapUnexpected", none, none),
        (sts.isNull(), "ScaleStatefulSet", "Pending", "CreatingStatefulSet", none, size),
        (F.col("__foreign"), "Wait", "Degraded", "AddressMismatch", none, none),
        (F.col("__clash"), "Wait", "Degraded", "MembershipConflict", none, none),
        (F.col("__far") | (at == "none"), "Wait", "Degraded", "UnexplainedDivergence", none, none),
        (late, "Wait", "Degraded", "PodUnavailable", none, none),
        ((at == "grow") & ~F.col("__up"), "Wait", "Scaling", "WaitingForPods", none, none),
        ((at == "grow") & taken, "Wait", "Scaling", "WaitingForOldVolume", none, none),
        (at == "grow", "ScaleStatefulSet", "Scaling", "AddingPod", none, s + 1),
        (at == "joining", "Wait", "Scaling", "WaitingForEpoch", none, none),
        ((at == "draining") & gone, "WriteConfigMap", "Scaling", "Drained", ec + 1, s - 1),
        ((at == "draining") & (F.col("drain_timeout_s") > 0) & (waited > F.col("drain_timeout_s")), "Wait", "DrainBlocked", "DrainBlocked", none, none),
        (at == "draining", "Wait", "Scaling", "Draining", none, none),
        (at == "shrink", "ScaleStatefulSet", "Scaling", "RemovingPod", none, size),
        (beyond, "Wait", "Scaling", "WaitingForPodRemoval", none, none),
        (volumes, "Wait", "Scaling", "WaitingForVolumeRemoval", none, none),
        (handing, "Wait", "Scaling", "WaitingForHandoff", none, none),
        (~F.col("__up"), "Wait", calm, "WaitingForPods", none, none),
        (rolling, "Wait", "Scaling", "RollingUpdate", none, none),
        (~sts["template_current"], "UpdateTemplate", "Scaling", "RollingUpdate", none, s),
        ((s < F.col("desired")) & taken, "Wait", "Scaling", "WaitingForOldVolume", none, none),
        (s < F.col("desired"), "WriteConfigMap", "Scaling", "AddingPod", ec + 1, s + 1),
        (s > F.col("desired"), "PostMembership", "Scaling", "RemovingPod", ec + 1, s - 1),
    ]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    decision = lambda a, p, r, e, n: F.struct(column(a).alias("action"), column(p).alias("phase"), column(r).alias("reason"), column(e).cast("long").alias("to_epoch"), column(n).cast("int").alias("to_size"))
    out = F.lit(None)
    for i, (when, *rest) in enumerate(ladder):
        hold = F.coalesce(when, F.lit(False))
        out = F.when(hold, decision(*rest)) if not i else out.when(hold, decision(*rest))
    out = out.otherwise(decision("None", "Ready", "Ready", none, none))
    d = d.withColumn("__d", out)
    keep = F.col("__d.reason").isin("Draining", "DrainBlocked")
    started = F.when(keep, F.coalesce("drain_started_s", "now_s")).when(F.col("__d.phase") == "Degraded", F.col("drain_started_s"))
    return d.select(*obs.columns, "__d.*", started.alias("drain_started"))


VIEW = "epoch long, n int, members map<string,string>, fingerprint string"


def loaded(files: DataFrame, text: str = "text") -> DataFrame:
    """Persisted views (JSON text, a row each) with their fields and a problem: not readable, or with a fingerprint of other members."""
    told = files.withColumn("v", F.from_json(text, VIEW))
    bad = F.col("v.members").isNull() | F.col("v.epoch").isNull()
    foreign = F.col("v.fingerprint") != fingerprint(F.col("v.members"), F.col("v.n"))
    return told.withColumn("problem", F.when(bad, "unreadable").when(F.coalesce(foreign, F.lit(True)), "another ring's fingerprint")).select(*files.columns, "v.*", "problem")


def persisted(views: DataFrame) -> DataFrame:
    """views (epoch, n, members) with text, what is kept of them on disk."""
    return views.withColumn("text", F.to_json(F.struct("epoch", "n", "members", fingerprint(F.col("members"), F.col("n")).alias("fingerprint"))))


def peer_states(pings: DataFrame, misses: int = 3) -> DataFrame:
    """By observer and peer of pings (seq, ok): reachable if the last was answered, alive unless the last misses in a row failed."""
    last_ok = F.max(F.when(F.col("ok"), F.col("seq")))
    by = pings.groupBy("observer", "peer").agg(last_ok.alias("__ok"), F.max("seq").alias("__last"))
    after = pings.join(by, ["observer", "peer"]).filter(F.col("__ok").isNull() | (F.col("seq") > F.col("__ok")))
    missed = after.groupBy("observer", "peer").agg(F.count("*").alias("missed"))
    out = by.join(missed, ["observer", "peer"], "left").withColumn("missed", F.coalesce("missed", F.lit(0).cast("long")))
    return out.select("observer", "peer", "missed", (F.col("missed") == 0).alias("reachable"), (F.col("missed") < misses).alias("alive"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
