"""Exact dedup: a tree of merges over sorted runs of digests, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import cut, steady, without_spaces

#: Runs that one merge takes in: three binomial rounds, of two runs each, in one exchange.
FAN_IN = 8
ENTRY = ["digest", "plain_chars", "verify"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row (its place), run (the task that read it), n_chars, and of the text
    without spaces the SHA-256 digest, its length and a second, unlike hash that verify it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = without_spaces(text)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.length(plain).alias("plain_chars"),
        F.xxhash64(plain).alias("verify"),
    )


def _range_of(ranges: int) -> Column:
    """Which of so many equal ranges of digests an entry is in; SHA-256 spreads them evenly."""
    return F.expr(f"cast((cast(conv(hex(substr(digest, 1, 4)), 16, 10) as long) * {ranges}) div 4294967296 as int)")


def _merged(runs: DataFrame, best: Column, n: Column) -> DataFrame:
    """One entry per (run, range, digest), the best; entries are of one text where the digest, the
    length and the verifying hash all agree."""
    return runs.groupBy("run", "range", *ENTRY).agg(best.alias("best"), n.alias("n"))


def merged_runs(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per group of equal texts: digest, plain_chars, verify, best (the row that stays), n (rows).

    Every task's rows are a run, sorted by digest, with one entry per text: a hot group is one
    entry per run. In a round, fan_in neighbouring runs become one: a run that is fan_in times
    as long lies in fan_in times as many ranges of the digest, so that each task takes the same
    range of fan_in runs, as in a butterfly of binomial exchanges, and the whole table moves
    once a round. A task sorts its slices into one (they are sorted, so this merges them) and
    reduces neighbours as they pass, verified at every level, until one run is left over all
    ranges. Rounds: the logarithm of the tasks to base fan_in; each is one exchange and one sort.
    """
    best = F.min(
        F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    )
    last = found.agg(F.max("run")).first()[0] or 0
    runs, ranges = found, 1
    while last or ranges == 1:
        last, ranges = last // fan_in, ranges * fan_in
        runs = runs.withColumn("run", F.expr(f"cast(run div {fan_in} as int)")).withColumn("range", _range_of(ranges))
        if ranges == fan_in:  # still rows, which Spark sorts and reduces to runs before they move
            runs = _merged(runs, best, F.count("*"))
        else:
            runs = _merged(runs.repartition("run", "range"), F.min("best"), F.sum("n"))
    return runs.drop("run", "range")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when they are identical without ASCII spaces. Of equal texts the one with
    the most code points stays, then the smallest doc_id, then the first row. Null texts count
    as empty, and all empty texts are equal; a null doc_id stays only where the group has no
    other of that length; of repeated rows exactly one stays; an empty table gives no rows.
    Other columns of docs are not carried, so their names cannot clash.
    """
    found = cut(digests(docs, id_col, text_col))
    groups = cut(merged_runs(found, fan_in), found.count())
    keep = groups.select(*ENTRY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")
    return found.join(keep, ENTRY).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup does not keep, all columns as they are.

    Rows are told apart by their place in the scan, so that repeated ids do no harm.
    """
    docs = steady(docs)
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("row").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(kept, "__row", "left_semi").drop("__row")
