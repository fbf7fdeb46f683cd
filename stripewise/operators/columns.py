"""Column operators: type inference, order-preserving dictionaries, statistics, sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.functions.codecs import compress, varint
from stripewise.operators.stripes import with_row_id

NULL_TEXT = "NULL"


def infer_types(df: DataFrame) -> dict[str, str]:
    """`INT` for columns of text whose values are all digits that fit BIGINT, or null, else
    `STRING`; a column of blanks and nulls alone is STRING."""
    number = lambda c: F.col(c).rlike("^[0-9]+$") & F.col(c).try_cast("bigint").isNotNull()
    checks = [F.coalesce(F.bool_and(F.col(c).isNull() | (F.col(c) == "") | number(c)), F.lit(False)).alias(c) for c in df.columns]
    some = [F.coalesce(F.bool_or(F.col(c).rlike("[0-9]")), F.lit(False)).alias(f"{c}__some") for c in df.columns]
    found = df.agg(*checks, *some).first()
    return {c: "INT" if found[c] and found[f"{c}__some"] else "STRING" for c in df.columns}


def typed(df: DataFrame) -> DataFrame:
    """df of text with integer columns as BIGINT, blanks in them as null. No value is lost: a
    column with a number too large for BIGINT, or with a sign, stays text."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).cast("bigint").alias(c) if t == "INT" else F.col(c) for c, t in infer_types(df).items()])


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in order as 1, 2, ...; null, even if absent, is 0."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    codes = with_row_id(values, "value", name="n").select("value", (F.col("n") + 1).alias("code"))
    null = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[column].dataType).alias("value"), F.lit(0).cast("long").alias("code"))
    return null.unionByName(codes)


def encode(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """df with the column's code added."""
    d = codes.select(F.col("value").alias("__value"), F.col("code").alias(name))
    return df.join(d, df[column].eqNullSafe(F.col("__value")), "left").drop("__value")


def decode(coded: DataFrame, codes: DataFrame, column: str = "code", name: str = "value") -> DataFrame:
    d = codes.select(F.col("code").alias("__code"), F.col("value").alias(name))
    return coded.join(d, coded[column] == F.col("__code"), "left").drop("__code")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, distinct (null counting as one), min, max."""
    c = F.col(column)
    return df.agg(
        F.count("*").alias("num_rows"),
        F.count_if(c.isNull()).alias("num_nulls"),
        (F.count_distinct(c) + F.max(F.coalesce(c.isNull().cast("int"), F.lit(0)))).cast("long").alias("num_distinct"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def column_moments(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, population variance, skewness and excess kurtosis, to six places."""
    c = F.col(column).cast("double")
    return df.agg(
        F.round(F.avg(c), 6).alias("mean"),
        F.round(F.var_pop(c), 6).alias("variance"),
        F.round(F.skewness(c), 6).alias("skewness"),
        F.round(F.kurtosis(c), 6).alias("kurtosis"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct()


def contains(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The values (column `value`) that occur in the column."""
    return values.join(df.select(F.col(column).alias("value")), "value", "left_semi")


def compressed_size(striped: DataFrame, column: str) -> DataFrame:
    """One row, size: bytes of the column compressed stripe by stripe (zstd, level 1); whole
    numbers as four bytes, or eight where they need them, dates as days and timestamps as
    microseconds in the same way, fractions as eight bytes, all else as text behind its length.
    Nulls are zeros or empty."""
    kind = dict(striped.dtypes)[column]
    value = {"date": F.unix_date(column), "timestamp": F.unix_micros(column)}[kind] if kind in ("date", "timestamp") else F.col(column)
    fraction = kind in ("double", "float") or kind.startswith("decimal")
    text = not (fraction or kind in ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "boolean"))
    value = value.cast("double" if fraction else "string" if text else "bigint")

    def size(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("row_id")["value"]
        if text:
            raw = b"".join(varint(len(b)) + b for b in (("" if v is None else v).encode() for v in values))
        elif fraction:
            raw = values.fillna(0).to_numpy().astype("<f8").tobytes()
        else:
            numbers = values.to_numpy().astype("<i8")
            wide = (np.abs(numbers) > 2**31 - 1).any()
            raw = numbers.astype("<i8" if wide else "<i4").tobytes()
        return pd.DataFrame({"size": [len(compress(raw))]})

    # Nulls of whole numbers are filled first: beside one, pandas would make fractions of them.
    moved = value if fraction or text else F.coalesce(value, F.lit(0).cast("bigint"))
    rows = striped.select("stripe_id", "row_id", moved.alias("value"))
    return rows.groupBy("stripe_id").applyInPandas(size, "size long").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, line): the decoded values of each row, null as `NULL`, joined by commas."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in columns]
    return rows.select("row_id", F.concat_ws(",", *cells).alias("line"))

