"""Command line: ``ask`` a question of the fact model, or ``list`` the queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("ask", help="answer one question for every entity")
    ask.add_argument("question")
    ask.add_argument("--data", required=True, help="folder of the Parquet tables")
    commands.add_parser("list", help="list the registered queries")
    args = parser.parse_args(argv)
    if args.command == "list":
        from .plans import catalog

        print("\n".join(sorted(catalog.queries())))
        return
    from .plans.answer_queries import answer

    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    answer(spark, args.data, [(1, args.question)]).show(50, truncate=False)


if __name__ == "__main__":
    main()
