"""A member's configuration file: strictly read, with defaults and the node id of the environment, as a row that the rules judge."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions.scalars import duration_ns_py
from quorumlens.operators import config

try:  # JSON, which is YAML too, is read without it
    import yaml
except ImportError:
    yaml = None

# The fields of a configuration file, and the durations by the names that the rules give them.
FIELDS = {
    "": {"nodeId", "listen", "dataDir", "cluster", "storage", "intervals", "timeouts", "health"},
    "listen": {"grpc", "http"},
    "cluster": {"n", "w", "r", "epoch", "members"},
    "storage": {"memtableBytes", "groupCommit"},
    "intervals": {"compaction", "antiEntropy", "hintDelivery", "heartbeat"},
    "timeouts": {"replication", "maxReconnectBackoff", "shutdown", "heartbeat"},
    "health": {"maxMissedHeartbeats"},
}
DURATIONS = {
    "compaction": ("intervals", "compaction"), "anti_entropy": ("intervals", "antiEntropy"), "hint_delivery": ("intervals", "hintDelivery"), "heartbeat": ("intervals", "heartbeat"),
    "replication": ("timeouts", "replication"), "max_reconnect_backoff": ("timeouts", "maxReconnectBackoff"), "shutdown": ("timeouts", "shutdown"), "heartbeat_timeout": ("timeouts", "heartbeat"),
}
DEFAULTS = {"heartbeat": 1_000_000_000, "heartbeat_timeout": 500_000_000, "max_missed": 3}
ROW = "node_id string, data_dir string, n int, w int, r int, epoch long, members array<struct<id:string,address:string>>, max_missed int, memtable_bytes long, group_commit boolean, " + ", ".join(f"{d} long" for d in config.DURATIONS)


def parsed(text: str) -> dict:
    """The document; a field that isn't known is an error."""
    told = (yaml.safe_load(text) if yaml is not None else json.loads(text)) or {}
    for part, names in FIELDS.items():
        own = told if not part else told.get(part) or {}
        if odd := set(own) - names:
            raise ValueError(f"unknown fields {sorted(odd)} in {part or 'the file'}")
    return told


def load(spark: SparkSession, texts: list[str], environment: dict[str, str] | None = None) -> DataFrame:
    """A row for each of a few files, with the first rule that it breaks (problem, null if it is valid)."""
    environment, rows = dict(os.environ) if environment is None else environment, []
    for text in texts:
        told = parsed(text)
        part = lambda name, told=told: told.get(name) or {}
        cluster = part("cluster")
        durations = {d: duration_ns_py(part(a)[b]) if part(a).get(b) else 0 for d, (a, b) in DURATIONS.items()}
        rows.append({
            "node_id": environment.get("KV_NODE_ID") or told.get("nodeId"), "data_dir": told.get("dataDir"), **{k: int(cluster.get(k) or 0) for k in ("n", "w", "r", "epoch")},
            "members": [(m["id"], m["address"]) for m in cluster.get("members") or []], "max_missed": part("health").get("maxMissedHeartbeats") or DEFAULTS["max_missed"],
            "memtable_bytes": part("storage").get("memtableBytes") or 0, "group_commit": part("storage").get("groupCommit") is not False,
            **{d: v or DEFAULTS.get(d, 0) for d, v in durations.items()},
        })
    return config.problems(spark.createDataFrame([tuple(r[c.split()[0]] for c in ROW.split(", ")) for r in rows], ROW).withColumn("members", F.coalesce("members", F.expr("array()"))))
