"""Runs registered queries: python -m corvane [--list] QUERY... --data FOLDER [--out FOLDER] [--show N] [--explain]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corvane.plans import contract


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane", description="Run registered queries over a folder of tables.")
    p.add_argument("query", nargs="*", help="names of queries")
    p.add_argument("--list", action="store_true", help="print all names and stop")
    p.add_argument("--data", help="folder with the tables, a Parquet file or folder each")
    p.add_argument("--out", help="write each result as Parquet under this folder")
    p.add_argument("--show", type=int, default=20, help="rows to print without --out")
    p.add_argument("--explain", action="store_true", help="print the plan instead of running it")
    given, known = p.parse_args(args), contract.queries()
    if given.list:
        print("\n".join(sorted(known)))
        return 0
    if not given.query or not given.data:
        p.error("a query and --data are needed")
    if wrong := [q for q in given.query if q not in known]:
        p.error(f"no such query: {', '.join(wrong)}")
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    for name in given.query:
        df = known[name](spark, given.data.rstrip("/"))
        if given.explain:
            df.explain("formatted")
        elif given.out:
            df.write.mode("overwrite").parquet(f"{given.out.rstrip('/')}/{name}")
        else:
            df.show(given.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
