"""Row numbers and stripes: fixed-size horizontal slices of an ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.session import kept


def with_row_id(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """df with gapless numbers from 0 in the given order.

    The table is range-partitioned and sorted once; each partition's row count, one number
    each, is summed up into offsets. No task sees more than its partition. The order should
    be unique, as the numbers of equal rows depend on the run otherwise.
    """
    spark = df.sparkSession
    rows = kept(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    offsets, at = [], 0
    for r in sorted(rows.groupBy("__part").count().collect()):  # one row per partition
        offsets.append((r["__part"], at))
        at += r["count"]
    base = spark.createDataFrame(offsets, "__part int, __base long")
    if len(offsets) <= 100_000:
        base = F.broadcast(base)
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(base, "__part").withColumn(name, F.col("__base") + local).drop("__at", "__part", "__base")


def assign_stripes(df: DataFrame, rows_per_stripe: int, *order: str | Column, keep_tail: bool = False) -> DataFrame:
    """df with row_id and stripe_id; rows behind the last complete stripe are dropped unless
    keep_tail, which gives them the next stripe's number (a pruned scan must read them)."""
    if rows_per_stripe <= 0:
        raise ValueError("rows_per_stripe must be positive")
    out = with_row_id(df, *order).withColumn("stripe_id", F.expr(f"cast(row_id div {rows_per_stripe} as int)"))
    return out if keep_tail else out.where(F.col("stripe_id") < F.lit(num_stripes(df, rows_per_stripe)))


def num_stripes(df: DataFrame, rows_per_stripe: int) -> int:
    """Complete stripes of the table."""
    return df.count() // rows_per_stripe


def reorder(rows: DataFrame, permutation: DataFrame, name: str = "row_id") -> DataFrame:
    """rows moved: position new_pos takes the row at old_pos (columns of permutation)."""
    moved = rows.join(permutation, rows[name] == permutation["old_pos"])
    return moved.drop(name, "old_pos").withColumnRenamed("new_pos", name)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> list[Column]:
    """Order keys of a random order that is the same in every run."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def cardinality_order(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns by number of distinct values (null counting as one), then by position."""
    counts = df.agg(
        *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    ).first()
    return sorted(columns, key=lambda c: (counts[c] or 0, columns.index(c)))


def sort_order(df: DataFrame, columns: list[str], how: str, unique_key: str) -> list[Column | str]:
    """Order keys for `none`, `by_cardinality` or `random`; the unique key settles ties."""
    if how == "none":
        return [unique_key]
    if how == "random":
        return shuffled(df, unique_key)
    if how == "by_cardinality":
        return [*cardinality_order(df, columns), unique_key]
    raise ValueError(f"unknown sorting: {how}")
