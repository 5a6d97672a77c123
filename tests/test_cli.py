"""The command line over files."""

import json
import sys

from quorumlens import __main__ as cli

TOPOLOGY = {
    "n": 3, "w": 2, "r": 2,
    "timing": {"heartbeatInterval": "1s", "heartbeatTimeout": "500ms", "maxMissedHeartbeats": 3, "replicationTimeout": "5s", "maxReconnectBackoff": "5s"},
    "pods": [{"id": f"kv-{i}", "address": f"kv-{i}:1", "node": f"n{i}", "zone": "bcddcb"[i]} for i in range(6)],
}


def test_predict_and_check(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "topology.json").write_text(json.dumps(TOPOLOGY))
    monkeypatch.setattr(sys, "argv", ["quorumlens", "predict", "--topology", str(tmp_path / "topology.json"), "--keys", "chaos-pre:5000"])
    assert cli.main() == 0
    out = capsys.readouterr().out
    assert "kv-0 holds  66.4%" in out and "partition:kv-1,kv-4" in out and "1419 ( 28.4%)" in out
    (tmp_path / "events.jsonl").write_text('{"time":"2024-01-10T00:00:00Z","test":"t","event":"inject","fault":"down:kv-0"}\n{"time":"2024-01-10T00:10:00Z","test":"t","event":"heal"}\n')
    at = 1704844800 * 10**9
    rows = [("put", "a", 100, "ok"), ("get", "a", 200, "ok"), ("get", "a", 700, "ok")]
    (tmp_path / "records.jsonl").write_text("".join(json.dumps({"test": "t", "seq": i, "op": o, "key": k, "target": "kv-1", "start": at + s * 10**9, "end": at + s * 10**9 + 1, "result": r}) + "\n" for i, (o, k, s, r) in enumerate(rows)))
    (tmp_path / "back.jsonl").write_text('{"key":"a","time":1,"result":"ok","owners":["kv-1"],"holders":["kv-1"]}\n')
    args = ["quorumlens", "check", "--topology", str(tmp_path / "topology.json"), "--events", str(tmp_path / "events.jsonl"), "--records", str(tmp_path / "records.jsonl"), "--readback", str(tmp_path / "back.jsonl")]
    monkeypatch.setattr(sys, "argv", args)
    assert cli.main() == 0
    assert "compared:  as-predicted=3" in (out := capsys.readouterr().out) and out.endswith("== PASS\n")
    with open(tmp_path / "records.jsonl", "a") as f:
        f.write(json.dumps({"test": "t", "seq": 9, "op": "get", "key": "a", "target": "kv-1", "start": at + 800 * 10**9, "end": at + 801 * 10**9, "result": "notfound"}) + "\n")
    assert cli.main() == 1
    assert "!stale-read=1" in capsys.readouterr().out
