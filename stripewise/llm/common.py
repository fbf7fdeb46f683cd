"""Helpers shared by the training-data operators.

Spaces are the six ASCII ones (space, tab, line feed, vertical tab, form feed, carriage
return), so that words are the same in Java, Python bytes and DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.session import delete_at_end, kept, scratch, shared_dir

__all__ = ["cut", "delete_at_end", "let", "shared_dir", "small_batches", "steady", "stored", "table", "without_spaces", "words_of"]

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
ROWS_A_FILE = 100_000  # of narrow rows
BATCH_BYTES = 4 << 20
MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared folder (see stripewise.session).

    most: what df, of narrow rows, has at most, where that is known. As many tasks as shuffle
    partitions would write a small df as hundreds of files, each of which costs two processes
    (chmod) on a local folder and two calls on any; so its last stage runs in as many tasks as
    these rows need, but in one for each core at least."""
    if most is not None:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS_A_FILE)))
    return kept(df)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of about BATCH_BYTES, where the session leaves that
    unset. By default a batch is ten thousand rows, which a worker and its executor hold several
    times over, and what a worker took once it hardly gives back."""
    if spark.conf.get(MOST_BATCH_BYTES, None) is None:
        spark.conf.set(MOST_BATCH_BYTES, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, for wide rows; it is deleted when
    the driver's JVM ends."""
    spark = df.sparkSession
    path = scratch(spark, f"stripewise-{name}")
    df.write.option("compression", "zstd").mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steady(df: DataFrame) -> DataFrame:
    """df such that monotonically_increasing_id() numbers its rows alike in every job: as it is
    where it only reads files, projected and filtered; any other is stored
    first, since a shuffle may deal its rows out anew.

    Spark cuts files by the number of cores at hand, which changes as executors come and go;
    so where the session leaves spark.sql.files.minPartitionNum unset it is set once."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    plan = df._jdf.queryExecution().optimizedPlan()
    names = {m[1] for m in (re.match(r"[\s:+\-]*'?(\w+)", x) for x in plan.toString().splitlines() if x.strip()) if m}
    if names <= {"Project", "Filter", "Relation"} and plan.deterministic():
        return df
    return stored(df, "rows")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside one projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
