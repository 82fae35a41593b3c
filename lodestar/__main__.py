"""``python -m lodestar NAME SF_DIR [OUT]``: runs a registered query, shows it or writes it as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestar.plans.queries import QUERIES


def main() -> None:
    parser = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    parser.add_argument("name", choices=sorted(QUERIES))
    parser.add_argument("sf_dir")
    parser.add_argument("out", nargs="?")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    rows = QUERIES[args.name](spark, args.sf_dir)
    if args.out:
        rows.write.parquet(args.out)
    else:
        rows.show(50, truncate=False)


if __name__ == "__main__":
    main()
