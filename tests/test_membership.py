"""The planner, step by step of a cluster that grows from four to five members and shrinks again."""

import copy

import pytest

from quorumlens.operators import membership

NOW = 10_000


def members(k):
    return {f"kv-{i}": f"kv-{i}.kv.kvstore.svc.cluster.local:7000" for i in range(k)}


def view(epoch, size, done=True):
    return {"epoch": epoch, "members": members(size), "handoff_epoch": epoch, "handoff_done": done}


def pod(i, epoch, size):
    return {"ordinal": i, "present": True, "terminating": False, "ready": True, "since_s": NOW - 3600, "membership": view(epoch, size), "unreachable_since_s": None, "drain": None}


def stable(k, epoch, desired):
    return {
        "cluster": "kv", "namespace": "kvstore", "now_s": NOW, "desired": desired, "grace_s": 120, "drain_timeout_s": 600, "drain_started_s": None, "prev_phase": "Ready",
        "sts": {"replicas": k, "ready": k, "rolled_out": True, "template_current": True}, "cm": {"epoch": epoch, "members": members(k), "invalid": None},
        "pods": [pod(i, epoch, k) for i in range(k)], "pvcs": list(range(k)),
    }


def case(k=4, epoch=2, desired=4, **paths):
    """A stable cluster with changes: a__b__0=v sets o[a][b][0]."""
    o = stable(k, epoch, desired)
    for path, v in paths.items():
        at = o
        *way, last = [int(x) if x.isdigit() else x for x in path.split("__")]
        for x in way:
            at = at[x]
        if v is DROP:
            del at[last]
        else:
            at[last] = v
    return o


DROP = object()
NEW = {"ordinal": 4, "present": True, "terminating": False, "ready": False, "since_s": NOW - 5, "membership": None, "unreachable_since_s": None, "drain": None}


def draining(drained, started=None, timeout=600):
    o = stable(5, 2, 4)
    for p in o["pods"]:
        p["membership"] = view(3, 4)
    o["pods"][4]["drain"] = {"epoch": 3, "drained": drained, "pending": 7}
    o["drain_started_s"], o["drain_timeout_s"] = started, timeout
    return o


def grown(ready):
    o = case(5, 3, 5)
    if not ready:
        for p in o["pods"]:
            p["membership"] = view(2, 4)
        o["pods"][4] = copy.deepcopy(NEW)
    return o


CASES = {
    "at rest": (stable(4, 2, 4), ("None", "Ready", "Ready", None, None)),
    "nothing yet": (case(sts=None, cm=None, pods=[], pvcs=[]), ("WriteConfigMap", "Pending", "CreatingConfigMap", 0, 4)),
    "only a config map": (case(sts=None, pods=[], desired=7), ("ScaleStatefulSet", "Pending", "CreatingStatefulSet", None, 4)),
    "wants one more": (stable(4, 2, 5), ("WriteConfigMap", "Scaling", "AddingPod", 3, 5)),
    "old volume in the way": (case(desired=5, pvcs=[0, 1, 2, 3, 4]), ("Wait", "Scaling", "WaitingForVolumeRemoval", None, None)),
    "config map ahead": (case(desired=5, cm={"epoch": 3, "members": members(5), "invalid": None}), ("ScaleStatefulSet", "Scaling", "AddingPod", None, 5)),
    "new pod comes up": (grown(False), ("Wait", "Scaling", "WaitingForEpoch", None, None)),
    "handoff runs": (case(5, 3, 5, pods__2__membership__handoff_done=False), ("Wait", "Scaling", "WaitingForHandoff", None, None)),
    "wants one less": (stable(5, 2, 4), ("PostMembership", "Scaling", "RemovingPod", 3, 4)),
    "drains": (draining(False), ("Wait", "Scaling", "Draining", None, None)),
    "drains too long": (draining(False, NOW - 700), ("Wait", "DrainBlocked", "DrainBlocked", None, None)),
    "drains without a limit": (draining(False, NOW - 700, 0), ("Wait", "Scaling", "Draining", None, None)),
    "has drained": (draining(True), ("WriteConfigMap", "Scaling", "Drained", 3, 4)),
    "config map behind": (case(5, 3, 4, cm={"epoch": 3, "members": members(4), "invalid": None}, **{f"pods__{i}__membership": view(3, 4) for i in range(5)}), ("ScaleStatefulSet", "Scaling", "RemovingPod", None, 4)),
    "template to apply": (case(sts__template_current=False), ("UpdateTemplate", "Scaling", "RollingUpdate", None, 4)),
    "rolls out": (case(sts__rolled_out=False), ("Wait", "Scaling", "RollingUpdate", None, None)),
    "a pod starts": (case(pods__3__ready=False, pods__3__membership=None, pods__3__since_s=NOW - 10), ("Wait", "Ready", "WaitingForPods", None, None)),
    "removed pod still there": (case(pods=[pod(i, 2, 4) for i in range(4)] + [NEW]), ("Wait", "Scaling", "WaitingForPodRemoval", None, None)),
    "foreign address": (case(desired=6, **{"pods__2__membership__members": {**members(4), "kv-1": "kv-1.kv.other.svc.cluster.local:7000"}}), ("Wait", "Degraded", "AddressMismatch", None, None)),
    "foreign member": (case(desired=6, **{"pods__2__membership__members": {**members(4), "db-9": "db-9.db.kvstore.svc.cluster.local:7000"}}), ("Wait", "Degraded", "AddressMismatch", None, None)),
    "one epoch, two memberships": (case(desired=6, pods__1__membership=view(2, 3)), ("Wait", "Degraded", "MembershipConflict", None, None)),
    "epochs two apart": (case(desired=6, pods__1__membership=view(4, 4)), ("Wait", "Degraded", "UnexplainedDivergence", None, None)),
    "three epochs": (case(desired=6, pods__1__membership=view(3, 4), pods__2__membership=view(1, 4)), ("Wait", "Degraded", "UnexplainedDivergence", None, None)),
    "a foreign change": (case(desired=6, pods__1__membership=view(3, 5)), ("Wait", "Degraded", "UnexplainedDivergence", None, None)),
    "config map with a gap": (case(desired=6, **{"cm__members": {k: v for k, v in members(4).items() if k != "kv-2"}}), ("Wait", "Degraded", "ConfigMapUnexpected", None, None)),
    "config map two ahead": (case(desired=6, cm={"epoch": 3, "members": members(6), "invalid": None}), ("Wait", "Degraded", "UnexplainedDivergence", None, None)),
    "config map missing": (case(desired=6, cm=None), ("Wait", "Degraded", "ConfigMapMissing", None, None)),
    "config map unreadable": (case(desired=6, cm__invalid="no epoch"), ("Wait", "Degraded", "ConfigMapUnexpected", None, None)),
    "pod down beyond grace": (case(desired=6, pods__3__ready=False, pods__3__membership=None, pods__3__since_s=NOW - 180), ("Wait", "Degraded", "PodUnavailable", None, None)),
    "ready but silent beyond grace": (case(desired=6, pods__3__membership=None, pods__3__unreachable_since_s=NOW - 180), ("Wait", "Degraded", "PodUnavailable", None, None)),
}


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [{**o, "prev_phase": f"{o['prev_phase']}"} for o, _ in CASES.values()]
    names = [c.split()[0] for c in ("cluster", "namespace", "now_s", "desired", "grace_s", "drain_timeout_s", "drain_started_s", "prev_phase", "sts", "cm", "pods", "pvcs")]
    df = spark.createDataFrame([tuple(r[n] for n in names) + (case,) for r, case in zip(rows, CASES, strict=True)], membership.OBSERVATION + ", case string")
    return {r["case"]: (r.action, r.phase, r.reason, r.to_epoch, r.to_size) for r in membership.plan(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_plan(decisions, name):
    assert decisions[name] == CASES[name][1]


def test_gossip_spreads(spark):
    views = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "node string, epoch long")
    links = spark.createDataFrame([("b", "a"), ("c", "b")], "node string, hears string")
    assert {r.node: r.epoch for r in membership.gossip(views, links, 1).collect()} == {"a": 3, "b": 3, "c": 1}
    assert {r.node: r.epoch for r in membership.gossip(views, links, 2).collect()} == {"a": 3, "b": 3, "c": 3}
