"""python -m alidade.cli FILE: runs a command file, or reads commands from the terminal."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from alidade.plans.session import Session


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("alidade").getOrCreate()
    session = Session(spark)
    if args:
        with open(args[0], encoding="utf-8") as f:
            print("\n".join(x for x in session.run(f.read()) if x))
        return 0
    while not session.done:
        try:
            line = input("> ")
        except EOFError:
            break
        print("\n".join(x for x in session.run(line) if x))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
