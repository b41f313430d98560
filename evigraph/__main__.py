"""Command line: list the registered queries, run one, or plan a refresh from a change list.

    python -m evigraph list
    python -m evigraph run NAME TABLES [--out FOLDER]
    python -m evigraph changes NAME_STATUS_FILE
"""

from __future__ import annotations

import argparse
import importlib

PLANS = ("evigraph.plans.problems", "evigraph.plans.graph_queries", "evigraph.plans.source_queries")


def known() -> dict:
    return {name: f for m in PLANS for name, f in importlib.import_module(m).QUERIES.items()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evigraph")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out")
    changes = commands.add_parser("changes")
    changes.add_argument("file")
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(known())))
        return 0
    from pyspark.sql import SparkSession

    from evigraph.sources.graphjson import categories, name_status

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "changes":
        listed = name_status(spark.read.text(given.file))
        listed.orderBy("path").show(1000, False)
        categories(listed).orderBy("category").show(20, False)
        return 0
    df = known()[given.name](spark, given.tables)
    if given.out:
        df.write.mode("overwrite").parquet(given.out)
    else:
        df.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
