"""python -m stripewise: evaluates the indexes on a table and writes a report.

Reads a CSV file or makes synthetic data, sorts it, builds the usual indexes for each column and
stripe size, runs the test cases and writes one CSV report; prints sizes and scan rates.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.functions.profiling import Phases
from stripewise.operators import evaluate, stripes
from stripewise.session import kept, session
from stripewise.sources import tables

SORTINGS = ("none", "by_cardinality", "random")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="stripewise", description=__doc__)
    p.add_argument("--generate-num-values", type=int, default=100_000, help="rows of synthetic data")
    p.add_argument("--num-unique-values", type=int, default=1000)
    p.add_argument("--input-csv", default="", help="read this file instead of making data")
    p.add_argument("--columns-to-test", default="", help="names joined by commas; all by default")
    p.add_argument("--num-rows-per-stripe-to-test", default="10000", help="sizes joined by commas")
    p.add_argument("--num-lookups", type=int, default=1000)
    p.add_argument("--test-cases", default=",".join(evaluate.CASES))
    p.add_argument("--sorting", choices=SORTINGS, default="none")
    p.add_argument("--output-csv", required=True)
    return p.parse_args(argv)


def table(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    if args.input_csv:
        names = args.columns_to_test.split(",") if args.columns_to_test else None
        df = tables.csv(spark, args.input_csv, names)
        return df, df.columns
    df = tables.uniform(spark, args.generate_num_values, args.num_unique_values)
    return df.withColumnRenamed("row_id", "source_row"), ["value"]


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    df, names = table(spark, args)
    key = "source_row"
    if key not in df.columns:
        df = kept(df.withColumn(key, F.monotonically_increasing_id()))  # the order of the file
    order = stripes.sort_order(df, names, args.sorting, key)

    def assign(size: int) -> tuple[DataFrame, int]:
        return stripes.assign_stripes(df, size, *order), stripes.num_stripes(df, size)

    sizes = [int(s) for s in args.num_rows_per_stripe_to_test.split(",")]
    phases = Phases()
    results = evaluate.experiments(assign, names, sizes, evaluate.usual_builders(), args.test_cases.split(","), args.num_lookups, phases)
    print(*phases.lines(), sep="\n")
    evaluate.write_report(results, args.output_csv)
    return results


if __name__ == "__main__":
    evaluate.summary(run(session(), arguments())).show(truncate=False)
