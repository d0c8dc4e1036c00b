"""Command-line driver: review a ledger and write the packet.

    python -m ledgerlens review --csv gl/*.csv --entity-type "Private for-profit" \\
        --benchmark 150000 --sensitivity "Balanced (0.05)" \\
        --period-start 2024-01-01 --period-end 2024-12-31 --out /shared/reviews/acme \\
        [--memos 10] [--memo-candidates candidates.parquet] [--format parquet|json]

Reads the ledger (CSV, or ``--parquet``), runs ``review()``, writes every review table
(plus the memo table and the CSV export of the queue when ``--memos`` is given) under
``--out`` and prints the request, materiality, summary and layer status as one JSON line.
"""
from __future__ import annotations

import argparse
import json
import sys

from .constants import MEMO_TOP_N_DEFAULT, MEMO_TOP_N_MAX, SENSITIVITY


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("review", help="review a general ledger and write the packet")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="ledger CSV file(s) or folder")
    r.add_argument("--multi-line", action=argparse.BooleanOptionalAction, default=None,
                   help="CSV fields may hold quoted line breaks (default: looked for)")
    src.add_argument("--parquet", help="ledger parquet file(s) or folder")
    r.add_argument("--entity-type", required=True)
    r.add_argument("--benchmark", type=float, required=True)
    r.add_argument("--sensitivity", required=True, choices=list(SENSITIVITY))
    r.add_argument("--period-start", required=True)
    r.add_argument("--period-end", required=True)
    r.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    r.add_argument("--format", default="parquet", choices=["parquet", "json"])
    r.add_argument("--memos", type=int, default=None, nargs="?", const=MEMO_TOP_N_DEFAULT,
                   choices=range(1, MEMO_TOP_N_MAX + 1), metavar="N",
                   help="also build memos for the top N queue rows (1..20)")
    r.add_argument("--memo-candidates", help="parquet table (position, memo_json) to validate")
    r.add_argument("--date-format", default=None)
    r.add_argument("--master", default=None, help="Spark master (default: the environment's)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators.memos import attach_memos, memo_table, memo_tallies
    from .plans.review import review
    from .session import ensure_checkpoint_dir, ship_package
    from .sources.csv_gl import read_csv_ledger, read_gl_parquet
    from .sources.sinks import export_csv, write_packet

    builder = SparkSession.builder.appName("ledgerlens-review")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    gl = read_csv_ledger(spark, args.csv, args.multi_line) if args.csv else read_gl_parquet(spark, args.parquet)
    packet = review(gl, args.entity_type, args.benchmark, args.sensitivity, args.period_start,
                    args.period_end, date_format=args.date_format)
    tables = dict(packet.tables)
    tables["feature_importance"] = spark.createDataFrame(
        sorted((packet.similarity.info.get("feature_importance") or {}).items(), key=lambda kv: -kv[1]),
        "feature string, importance double")
    if args.memos is not None:
        cands = spark.read.parquet(args.memo_candidates) if args.memo_candidates else None
        memos = memo_table(packet.flagged, args.memos, cands)
        tables["memos"] = memos
        tables["memo_tallies"] = memo_tallies(memos)
        export_csv(attach_memos(packet.flagged, memos), f"{args.out.rstrip('/')}/flagged_export_csv")
    else:
        export_csv(packet.flagged, f"{args.out.rstrip('/')}/flagged_export_csv")
    write_packet(tables, args.out, fmt=args.format)
    summary = packet.tables["review_summary"].first().asDict()
    info = {k: v for k, v in packet.similarity.info.items() if k != "feature_importance"}
    packet.close()
    print(json.dumps({"request": packet.request, "materiality": packet.materiality,
                      "summary": summary, "hybrid_layer": info, "out": args.out,
                      "timings": packet.timings}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
