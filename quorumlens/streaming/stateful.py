"""Structured Streaming forms: versioned writes per key, the failure detector, hint lifecycles, layers flushed by batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quorumlens.operators.versions import survivors


def covers(a: dict, b: dict) -> bool:
    return all(a.get(k, 0) >= v for k, v in b.items())


def versioned_puts(writes: DataFrame) -> DataFrame:
    """A stream of writes (key, seq, node, value_json, context map or null, is_deleted) as the versions they make.

    Each key's siblings are its state, so writes of a key are applied one after another. A null context builds on all
    that exists, an empty one on nothing; a delete of a key without versions makes none.
    """
    out = "key string, seq long, value_json string, clock map<string,bigint>, last_updated_by string, is_deleted boolean, siblings int, applied boolean"

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        siblings = json.loads(state.get[0]) if state.exists else []  # clocks, oldest first
        rows = []
        for w in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            if w.is_deleted and not siblings:
                continue
            given = None if w.context is None else {k: int(v) for k, v in dict(w.context).items()}
            base = {k: max(s.get(k, 0) for s in siblings) for k in {k for s in siblings for k in s}} if given is None else given
            clock = {**base, w.node: base.get(w.node, 0) + 1}
            applied = not any(covers(s, clock) for s in siblings)
            if applied:
                siblings = [s for s in siblings if not covers(clock, s)] + [clock]
            rows.append((key[0], w.seq, w.value_json, clock, w.node.partition("#")[0], w.is_deleted, len(siblings), applied))
        state.update((json.dumps(siblings),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return writes.groupBy("key").applyInPandasWithState(apply, out, "siblings string", "append", GroupStateTimeout.NoTimeout)


def failure_detector(pings: DataFrame, misses: int = 3) -> DataFrame:
    """A stream of pings (observer, peer, seq, ok) as changes of state: dead at the misses-th failure in a row, alive at a success."""
    out = "observer string, peer string, seq long, dead boolean"

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed, dead = state.get if state.exists else (0, False)
        rows = []
        for p in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            missed = 0 if p.ok else missed + 1
            now = missed >= misses
            if now != dead:
                dead = now
                rows.append((*key, p.seq, dead))
        state.update((int(missed), bool(dead)))
        yield pd.DataFrame(rows, columns=["observer", "peer", "seq", "dead"])

    return pings.groupBy("observer", "peer").applyInPandasWithState(watch, out, "missed int, dead boolean", "append", GroupStateTimeout.NoTimeout)


def flush_to_layers(path: str, max_bytes: int):
    """A foreachBatch function: each batch is resolved and appended to the open layer; a layer over max_bytes is closed.

    Layers are folders layer=N; a batch that runs again after a failure overwrites its own part, and equal versions merge.
    """

    def flush(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        layers = sorted(int(s.getPath().getName().removeprefix("layer=")) for s in files.listStatus(at) if s.getPath().getName().startswith("layer=")) if files.exists(at) else []
        layer = layers[-1] if layers else 0
        if layers and files.getContentSummary(jvm.org.apache.hadoop.fs.Path(f"{path}/layer={layer}")).getLength() >= max_bytes:
            layer += 1
        survivors(batch).sortWithinPartitions("key", "seq").write.mode("overwrite").parquet(f"{path}/layer={layer}/batch={epoch}")

    return flush


def visible(spark, path: str) -> DataFrame:
    """What all layers under path show together."""
    layers = spark.read.parquet(path)
    return survivors(layers.withColumn("layer_rank", -F.col("layer")), order=("layer_rank", "seq")).drop("layer_rank", "layer", "batch")


def hint_state(changes: DataFrame) -> DataFrame:
    """A stream of hints and deliveries (target, key, clock, delivered) as the pending count of each target's key after every change.

    State is held by target and key, so a target with very many hints is dealt to many tasks; a target's own count is the
    sum over its keys of the last pending.
    """
    out = "target string, key string, pending int"

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []  # clocks of one key
        for c in pd.concat(list(frames)).itertuples(index=False):
            clock = {k: int(v) for k, v in dict(c.clock).items()}
            if c.delivered or not any(covers(h, clock) for h in held):
                held = [h for h in held if not covers(clock, h)] + ([] if c.delivered else [clock])
        if held:
            state.update((json.dumps(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, len(held))], columns=["target", "key", "pending"])

    return changes.groupBy("target", "key").applyInPandasWithState(keep, out, "held string", "update", GroupStateTimeout.NoTimeout)
