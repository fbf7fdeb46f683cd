"""Reading tables: Parquet, CSV with the engine's own type rules, and synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.operators.columns import typed

# Fixed values of the linear congruence that spreads synthetic values.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 1 << 31


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header: `NULL` is null, a column of digits is BIGINT, all else text.

    Asking for an unknown column is an error that lists those there are."""
    raw = spark.read.csv(path, header=True, nullValue="NULL", inferSchema=False, mode="FAILFAST")
    if columns is not None:
        unknown = [c for c in columns if c not in raw.columns]
        if unknown:
            raise ValueError(f"no column {', '.join(unknown)}; there are {', '.join(raw.columns)}")
        raw = raw.select(*columns)
    return typed(raw)


def from_columns(spark: SparkSession, columns: dict[str, list], types: dict[str, str] | None = None) -> DataFrame:
    """A small table from equally long lists, with row_id."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) != 1:
        raise ValueError("the columns differ in length")
    kind = lambda c: (types or {}).get(c) or ("string" if any(isinstance(v, str) for v in columns[c]) else "bigint")
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"`{c}` {kind(c)}" for c in columns))


def uniform_name(rows: int, distinct: int) -> str:
    return f"uni_{rows // 1000}K_val_{distinct}_uniq"


def uniform(spark: SparkSession, rows: int, distinct: int) -> DataFrame:
    """(row_id, value): rows of `distinct` values drawn alike, each at least once, in an order
    that a hash mixes; the same in every run and for every partitioning."""
    if not 0 < distinct <= rows:
        raise ValueError("there must be 1 to `rows` distinct values")
    pick = F.when(F.col("id") < distinct, F.col("id")).otherwise(F.pmod(F.col("id") * MULTIPLIER + INCREMENT, F.lit(MODULUS)) % distinct)
    value = F.pmod(pick * 48271 + 11, F.lit(MODULUS - 1)).alias("value")
    from stripewise.operators.stripes import with_row_id

    return with_row_id(spark.range(rows).select("id", value), F.md5(F.col("id").cast("string")), "id").select("row_id", "value")
