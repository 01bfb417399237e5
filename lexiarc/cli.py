"""Command line: init, the stages, terms and approve for their review, status, stats, logs."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import state
from .plans.pipeline import Pipeline, Settings
from .schemas import TABLES
from .store import Store

STEPS = ("scan", "extract", "terminology", "translate", "export", "run")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexiarc", description=__doc__)
    parser.add_argument("command", choices=["init", *STEPS, "terms", "approve", "status", "stats", "logs"])
    parser.add_argument("--store", required=True)
    parser.add_argument("--config")
    parser.add_argument("--file", help="the list of terms: where terms writes it and approve reads it")
    parser.add_argument("--level")
    parser.add_argument("--stage")
    parser.add_argument("--limit", type=int, default=50)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lexiarc").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    plan = Pipeline(spark, store, Settings.from_yaml(args.config) if args.config else Settings())
    if args.command in ("terms", "approve") and not args.file:
        parser.error(f"{args.command} needs --file")
    if args.command in STEPS:
        getattr(plan, args.command)()
    elif args.command == "init":
        for name, schema in TABLES.items():
            if store.version(name) is None:
                store.replace(name, spark.createDataFrame([], schema))
    elif args.command == "terms":
        plan.export_terms(args.file)
    elif args.command == "approve":
        plan.import_terms(args.file)
    elif args.command == "stats":
        counts = [store.read(name, schema).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, schema in TABLES.items()]
        reduce(DataFrame.unionByName, counts).show()
    elif args.command == "status":
        store.read("doc_catalog", TABLES["doc_catalog"]).groupBy("status").agg(F.count(F.lit(1)).alias("n")).show()
    else:
        log = store.read("processing_log", TABLES["processing_log"])
        state.filtered_log(log, args.limit, level=args.level.upper() if args.level else None, stage=args.stage).show(args.limit, truncate=60)


if __name__ == "__main__":
    main()
