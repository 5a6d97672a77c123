"""python -m quorumlens predict|check: the prediction's and the checker's text reports over files.

predict --topology FILE --keys PREFIX:COUNT [--fault SPEC ...] [--per-key FOLDER]
check   --topology FILE --events FILE --records FILE ... [--readback FILE ...] [--tolerance 2s] [--converged]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quorumlens.functions.scalars import duration_ns_py
from quorumlens.operators import chaos, placement
from quorumlens.sources import logs, sinks


def predict(spark: SparkSession, args: argparse.Namespace) -> int:
    t = logs.topology(Path(args.topology).read_text(encoding="utf-8"))
    placed = placement.owners_of(logs.keys(spark, args.keys), t.pods, t.n)
    faults = [chaos.parse_fault(f, t) for f in args.fault] if args.fault else t.standard_faults()
    frame = chaos.faults_frame(spark, t, faults)
    if args.per_key:
        if len(faults) != 1:
            raise SystemExit("--per-key takes one --fault")
        sinks.write_json_lines(sinks.per_key_predictions(chaos.predictions(placed, frame, t), t.zones), args.per_key)
    sys.stdout.write(sinks.predict_text(placement.shares(placed, t.pods), chaos.summary(placed, frame, t)))
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    t = logs.topology(Path(args.topology).read_text(encoding="utf-8"))
    events = logs.events(spark, args.events)
    if errors := chaos.timeline_errors(events, t).orderBy("test", "error").collect():  # a few rows for each test
        raise SystemExit("\n".join(f"test {e.test}: {e.error}" for e in errors))
    lines = chaos.timelines(events, t, duration_ns_py(args.tolerance))
    requests = logs.requests(spark, args.records)
    rows = chaos.judged(requests, lines, t).persist()
    back = logs.readbacks(spark, args.readback) if args.readback else None
    report = chaos.readback_report(requests, back, rows.filter("expected_under"), args.converged) if back is not None else None
    text = sinks.report_text(rows, lines, report, chaos.listed(requests, back) if back is not None else None)
    rows.unpersist()
    sys.stdout.write(text)
    return 0 if text.endswith("== PASS\n") else 1


def main() -> int:
    parser = argparse.ArgumentParser(prog="quorumlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("predict")
    p.add_argument("--keys", required=True)
    p.add_argument("--fault", action="append")
    p.add_argument("--per-key")
    c = commands.add_parser("check")
    c.add_argument("--events", required=True)
    c.add_argument("--records", nargs="+", required=True)
    c.add_argument("--readback", nargs="*")
    c.add_argument("--tolerance", default="2s")
    c.add_argument("--converged", action="store_true")
    for each in (p, c):
        each.add_argument("--topology", required=True)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("quorumlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"predict": predict, "check": check}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
