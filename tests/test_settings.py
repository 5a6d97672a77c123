"""Configuration files: strict fields, defaults, the environment's node id, and the rules."""

import json

import pytest

from quorumlens.sources import settings


def file(**changes):
    told = {
        "nodeId": "kv-0", "dataDir": "/data", "cluster": {"n": 3, "w": 2, "r": 2, "epoch": 1, "members": [{"id": f"kv-{i}", "address": f"a:{i}"} for i in range(3)]},
        "storage": {"memtableBytes": 1000}, "intervals": {"compaction": "1m", "antiEntropy": "30s", "hintDelivery": "5s"}, "timeouts": {"replication": "2s", "maxReconnectBackoff": "5s", "shutdown": "10s"},
    }
    for path, value in changes.items():
        *parts, last = path.split("__")
        at = told
        for p in parts:
            at = at[p]
        at[last] = value
    return json.dumps(told)


def test_defaults_and_environment(spark):
    r = settings.load(spark, [file()], {"KV_NODE_ID": "kv-2"}).first()
    assert (r.problem, r.node_id, r.heartbeat, r.heartbeat_timeout, r.max_missed, r.group_commit, r.compaction) == (None, "kv-2", 1_000_000_000, 500_000_000, 3, True, 60_000_000_000)


def test_rules(spark):
    broken = {
        "node id missing": file(nodeId=""), "node id with separator": file(nodeId="a#b"), "node is no member": file(nodeId="kv-9"), "data directory missing": file(dataDir=""), "w out of range": file(cluster__w=4), "r out of range": file(cluster__r=0),
        "n over members": file(cluster__n=4), "member id twice": file(cluster__members=[{"id": "kv-0", "address": "a"}, {"id": "kv-0", "address": "b"}]), "address twice": file(cluster__members=[{"id": "kv-0", "address": "a"}, {"id": "kv-1", "address": "a"}]),
        "duration not positive": file(timeouts__shutdown="0s"), "heartbeat timeout not under interval": file(timeouts__heartbeat="1s"), "memtable not positive": file(storage__memtableBytes=-1),
        "missed heartbeats not positive": file(health={"maxMissedHeartbeats": -1}), "member id with separator": file(cluster__members=[{"id": "a#b", "address": "a"}]),
    }
    assert [r.problem for r in settings.load(spark, list(broken.values()), {}).collect()] == list(broken)
    with pytest.raises(ValueError, match="unknown fields"):
        settings.load(spark, [file(extra=1)], {})
    with pytest.raises(ValueError, match="in cluster"):
        settings.load(spark, [file(cluster__size=1)], {})
