"""Command line: ``python -m vigilake.cli query|alerts|run|watch``."""

from __future__ import annotations

import argparse
import csv
import sys
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from vigilake.operators.detect import RuleSet
from vigilake.operators.stateful import open_alerts
from vigilake.plans import modes
from vigilake.plans.query import Lake, tiers
from vigilake.session import build
from vigilake.sources import sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vigilake")
    sub = out.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="SQL over a time range of the lake")
    q.add_argument("--sql", required=True, help="{TABLE} stands for the log type's table")
    q.add_argument("--lake", required=True)
    q.add_argument("--log-type", default="cloudtrail")
    q.add_argument("--last", default="24h")
    q.add_argument("--start")
    q.add_argument("--end")
    q.add_argument("--output", choices=("table", "json", "csv"), default="table")
    a = sub.add_parser("alerts", help="a page of the open alerts")
    a.add_argument("--table", required=True, help="Parquet folder of alerts")
    a.add_argument("--limit", type=int, default=100)
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--json", action="store_true")
    a.add_argument("--timing", action=argparse.BooleanOptionalAction, default=True)
    r = sub.add_parser("run", help="matches of the records in files")
    r.add_argument("paths", nargs="+")
    w = sub.add_parser("watch", help="matches of a directory's new files")
    w.add_argument("path")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--every")
    for p in (r, w):
        p.add_argument("--mode", choices=("reference", "intended"), default="intended")
        p.add_argument("--packs", nargs="*")
    return out


def _shown(df: DataFrame, output: str) -> None:
    if output == "csv":
        rows = csv.writer(sys.stdout)
        rows.writerow(df.columns)
        rows.writerows(["" if v is None else v for v in r] for r in df.toLocalIterator())
    else:
        print(sinks.result_json(df) if output == "json" else sinks.result_table(df))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build()
    began = time.time()
    if args.command == "query":
        at = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00")) if s else None
        start, end = (at(args.start), at(args.end)) if args.start and args.end else (None, None)
        if start:
            print("range: " + ", ".join(f"{kind} {a.isoformat()} to {b.isoformat()}" for kind, a, b in tiers(start, end)), file=sys.stderr)
        _shown(Lake(spark, args.lake).query(args.sql, args.log_type, start, end, args.last), args.output)
    elif args.command == "alerts":
        page = open_alerts(spark.read.parquet(args.table), args.limit, args.offset).select("rule_id", "severity", "updated_at", "title")
        _shown(page, "json" if args.json else "table")
        if args.timing:
            print(f"alerts: {time.time() - began:.3f} s", file=sys.stderr)
    else:
        rules = RuleSet(args.mode, args.packs or None)
        show = lambda found: sinks.print_matches(found.matches)
        if args.command == "run":
            show(modes.once(spark, *args.paths, rules=rules))
        else:
            modes.watch(spark, args.path, args.checkpoint, show, rules, args.every).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
