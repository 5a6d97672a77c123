"""Rules of a member's configuration, as the first one that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Durations (nanoseconds) that must be positive.
DURATIONS = ["compaction", "anti_entropy", "hint_delivery", "replication", "max_reconnect_backoff", "shutdown", "heartbeat", "heartbeat_timeout"]


def problem(members: Column) -> Column:
    """The first rule that a configuration breaks, null if it is valid; columns node_id, data_dir, n, w, r, DURATIONS, max_missed, memtable_bytes."""
    c = F.col
    ids, addresses = F.transform(members, lambda m: m["id"]), F.transform(members, lambda m: m["address"])
    twice = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    rules = {
        "node id missing": F.coalesce(c("node_id"), F.lit("")) == "",
        "node id with separator": c("node_id").contains("#"),
        "member id with separator": F.exists(ids, lambda i: i.contains("#")),
        "member id twice": twice(ids),
        "address twice": twice(addresses),
        "node is no member": ~F.array_contains(ids, c("node_id")),
        "data directory missing": F.coalesce(c("data_dir"), F.lit("")) == "",
        "w out of range": (c("w") < 1) | (c("w") > c("n")),
        "r out of range": (c("r") < 1) | (c("r") > c("n")),
        "n over members": c("n") > F.size(members),
        "duration not positive": F.least(*[c(d) for d in DURATIONS]) <= 0,
        "heartbeat timeout not under interval": c("heartbeat_timeout") >= c("heartbeat"),
        "missed heartbeats not positive": c("max_missed") <= 0,
        "memtable not positive": c("memtable_bytes") <= 0,
    }
    return F.coalesce(*[F.when(broken, name) for name, broken in rules.items()])


def problems(configs: DataFrame, members: str = "members") -> DataFrame:
    return configs.withColumn("problem", problem(F.col(members)))
