"""Scans that read only the stripes that an index names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stripes named in a filter; more are joined, which prunes while the query runs.
MOST_LISTED = 10_000
ROW_GROUP_BYTES = 16 << 20


def write_striped(striped: DataFrame, path: str) -> None:
    """The striped table (tail included) as files of many stripes each, sorted by stripe, so that
    the statistics of their row groups and pages lead a reader to a stripe. The number of files
    follows the size of the table and not the number of stripes."""
    ordered = striped.repartitionByRange("stripe_id").sortWithinPartitions("stripe_id", "row_id")
    ordered.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def pruned_scan(spark: SparkSession, path: str, column: str, values: list, candidates: DataFrame, num_stripes: int) -> DataFrame:
    """Rows of the table at path whose column has one of the values.

    candidates: (value, stripe_id) from any index. Their stripes, and the tail behind the last
    complete one, become a filter on stripe_id, which Spark pushes down to the files; the values
    are filtered for again, so a stripe too many does no harm."""
    table = spark.read.parquet(path)
    hit = candidates.where(F.col("value").isin(values)).select("stripe_id").distinct()
    listed = [r[0] for r in hit.limit(MOST_LISTED + 1).collect()]
    rows = table.where(F.col(column).isin(values))
    if len(listed) <= MOST_LISTED:
        return rows.where(F.col("stripe_id").isin(listed) | (F.col("stripe_id") >= num_stripes))
    tail = spark.range(num_stripes, num_stripes + 1).select(F.col("id").cast("int").alias("stripe_id"))
    return rows.join(hit.unionByName(tail), "stripe_id", "left_semi")


def conjunction(*found: DataFrame) -> DataFrame:
    """Stripes (stripe_id) that all of several lookups name: `a = 1 and b = 2`."""
    out = found[0].select("stripe_id").distinct()
    for f in found[1:]:
        out = out.join(f.select("stripe_id").distinct(), "stripe_id", "left_semi")
    return out


def disjunction(*found: DataFrame) -> DataFrame:
    """Stripes that any of several lookups names: `a in (...)`, `a = 1 or b = 2`."""
    out = found[0].select("stripe_id")
    for f in found[1:]:
        out = out.unionByName(f.select("stripe_id"))
    return out.distinct()
