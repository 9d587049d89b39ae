"""python -m cairn list, or python -m cairn run QUERY --data FOLDER [--out FOLDER]."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from cairn.plans.catalogue import QUERIES


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cairn")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    rows = QUERIES[given.query](SparkSession.builder.getOrCreate(), given.data)
    if given.out:
        rows.write.mode("errorifexists").parquet(given.out)
    else:
        rows.show(truncate=False)


if __name__ == "__main__":
    main()
