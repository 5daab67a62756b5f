"""Command line: list the analyses or run one.

    python -m clickmetrics list
    python -m clickmetrics run m26_landing_ab_test --tables /data/web [--format csv] [--show 50]
    python -m clickmetrics run m27_weekly_trend --events /data/sf1 [--out /data/out/m27]

``--tables`` and ``--database`` read the four web tables and use the reference's parameters;
``--events`` derives them from ``events.parquet`` and uses the catalog's.
``--out`` writes the whole result as Parquet; otherwise ``--show`` rows are
printed.
"""

from __future__ import annotations

import argparse
import sys

from clickmetrics.plans.catalog import CATALOG, Prepared, run
from clickmetrics.plans.reference import ALL_PLANS, run_on_tables
from clickmetrics.session import get_spark
from clickmetrics.sources.tables import load_database


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="clickmetrics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("name")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with website_sessions/website_pageviews/orders/order_items")
    src.add_argument("--database", help="catalog database with those tables")
    src.add_argument("--events", help="folder with events.parquet")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    r.add_argument("--collate", action="store_true", help="with --tables or --database: ignore case and trailing blanks of text")
    r.add_argument("--out", help="write the result here as Parquet")
    r.add_argument("--show", type=int, default=20)
    r.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        for name in ALL_PLANS:
            print(name)
        return 0

    known = CATALOG if args.events else ALL_PLANS
    if args.name not in known:
        print(f"unknown analysis {args.name!r}; see `python -m clickmetrics list`", file=sys.stderr)
        return 2
    spark = get_spark(args.master)
    if args.database:
        tables = load_database(spark, args.database)
        df = ALL_PLANS[args.name](Prepared(tables.collated() if args.collate else tables))
    elif args.tables:
        df = run_on_tables(args.name, spark, args.tables, args.format, collate=args.collate)
    else:
        df = run(args.name, spark, args.events)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)
        print(f"(at most {args.show} rows shown; --out writes the whole result)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
