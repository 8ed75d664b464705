"""python -m chatloom: list the queries, run one over a folder of tables, look at a dataset or validate one."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from chatloom import api
from chatloom.plans.all import QUERIES, SQL
from chatloom.sources import stores


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chatloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="write a query's rows as Parquet, or show some")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    for name in ("inspect", "validate"):
        commands.add_parser(name).add_argument("source")
    load = commands.add_parser("load", help="training and validation sets of sources, as Parquet")
    load.add_argument("sources", nargs="+")
    load.add_argument("--out", required=True)
    load.add_argument("--validation", nargs="*")
    load.add_argument("--seed", type=int, default=42)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(f"{name}{'' if name in SQL else ' (no SQL)'}" for name in sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("chatloom").getOrCreate()
    if args.command == "run":
        rows = QUERIES[args.query](spark, args.tables)
        rows.write.parquet(args.out) if args.out else rows.show(args.show, truncate=80)
    elif args.command == "inspect":
        print(json.dumps(stores.inspected(spark, args.source).head().asDict(), default=str))
    elif args.command == "validate":
        print(json.dumps(api.validate_training_source(spark, args.source)))
    else:
        for name, rows in zip(("train", "validation"), api.load_training_data(spark, args.sources, seed=args.seed, validation_sources=args.validation), strict=True):
            rows.write.parquet(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
