"""Lookup workloads, and what an index makes of them: stripes read in vain, sizes, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.functions.profiling import Phases
from stripewise.operators import bloom, cuckoo, truth, xor8, zonemap
from stripewise.operators.bitmaps import bitpacked_size, codec_sizes, global_measures
from stripewise.operators.columns import compressed_size
from stripewise.operators.stripes import with_row_id
from stripewise.session import kept

# Fixed values of the linear congruence that draws positions, alike in every engine.
LCG_MULTIPLIER, LCG_INCREMENT = 2654435761, 12345
NEGATIVE_BASE = 1 << 40
ZIPF_SCALE = 10**12
MOST_RANKS = 1_000_000

# The report's columns with their types.
REPORT = (
    "index_structure:STRING, num_rows_per_stripe:INT, num_stripes:INT, column_name:STRING, column_type:STRING, "
    "column_cardinality:INT, column_compressed_size_bytes:INT, index_size_bytes:INT, index_compressed_size_bytes:INT, "
    "bitmap_density:DOUBLE, bitmap_clustering:DOUBLE, bitmap_bitpacked_size:INT, bitmap_bitpacked_compressed_size:INT, "
    "bitmap_roaring_size:INT, bitmap_roaring_compressed_size:INT, bitmap_roaring_individual_size:INT, "
    "bitmap_roaring_individual_compressed_size:INT, bitmap_rle_size:INT, bitmap_rle_compressed_size:INT, "
    "test_case:STRING, num_lookups:INT, num_false_positives:INT, num_true_negatives:INT"
).split(", ")

CASES = ("positive_uniform", "positive_distinct", "positive_zipf", "negative", "mixed")


def _lcg(i: Column, n: Column | int, salt: int = 0) -> Column:
    return F.pmod(i * LCG_MULTIPLIER + (LCG_INCREMENT + salt), F.lit(n) if isinstance(n, int) else n)


def _ranked(striped: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values in order, from 0."""
    return with_row_id(truth.pairs(striped, column).select("value").distinct(), "value", name="rank")


def positive_uniform(striped: DataFrame, column: str, lookups: int) -> DataFrame:
    """(i, value): the values of rows drawn alike, null rows left out."""
    rows = with_row_id(striped.where(F.col(column).isNotNull()).select("row_id", F.col(column).alias("value")), "row_id", name="at")
    n = rows.count()
    draws = striped.sparkSession.range(lookups).select(F.col("id").alias("i"), _lcg(F.col("id"), n).alias("at"))
    return draws.join(rows.select("at", "value"), "at").select("i", "value")


def positive_distinct(striped: DataFrame, column: str, lookups: int, salt: int = 0) -> DataFrame:
    """(i, value): distinct values drawn alike."""
    ranked = _ranked(striped, column)
    n = ranked.count()
    draws = striped.sparkSession.range(lookups).select(F.col("id").alias("i"), _lcg(F.col("id"), n, salt).alias("rank"))
    return draws.join(ranked, "rank").select("i", "value")


def positive_zipf(striped: DataFrame, column: str, lookups: int) -> DataFrame:
    """(i, value): rank k, by value from 0, drawn with weight 1 / (k + 1)**2, in whole numbers.

    Weights past rank 10**6 are zero, so the cumulative weights are a list of bounded size, which
    every task makes for itself; a draw is found in it, and its rank meets the values."""
    ranked = _ranked(striped, column).where(F.col("rank") < MOST_RANKS)
    n = ranked.count()

    def upto() -> np.ndarray:
        return np.cumsum(ZIPF_SCALE // np.arange(1, n + 1, dtype=np.int64) ** 2)

    total = int(upto()[-1]) if n else 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = upto()
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "rank": np.searchsorted(ends, b["u"].to_numpy(), side="right")})

    draws = striped.sparkSession.range(lookups).select(F.col("id").alias("i"), _lcg(F.col("id") * 7919, total).alias("u"))
    return draws.mapInPandas(place, "i long, rank long").join(ranked, "rank").select("i", "value")


def negative(striped: DataFrame, column: str, lookups: int, salt: int = 0) -> DataFrame:
    """(i, value): whole numbers that the column does not hold."""
    spark = striped.sparkSession
    draws = spark.range(2 * lookups + 16).select(F.col("id").alias("i"), (_lcg(F.col("id"), NEGATIVE_BASE, salt) - (1 << 20)).alias("value"))
    values = truth.pairs(striped, column).select(F.col("value").cast("long").alias("value"))
    free = with_row_id(draws.join(values, "value", "left_anti"), "i", name="n")
    return free.where(F.col("n") < lookups).select(F.col("n").alias("i"), "value")


def mixed(striped: DataFrame, column: str, lookups: int) -> dict[int, DataFrame]:
    """By tenths: (i, value), where draw i is positive in tenths out of ten. Both kinds are drawn
    once for all eleven."""
    tenth = F.pmod(F.col("i") * 7 + 3, F.lit(10))
    yes = positive_distinct(striped, column, lookups, salt=1).select("i", F.col("value").cast("long").alias("value"))
    both = kept(yes.withColumn("yes", F.lit(True)).unionByName(negative(striped, column, lookups, salt=1).withColumn("yes", F.lit(False))))
    return {t: both.where(F.col("yes") == (tenth < t)).select("i", "value") for t in range(11)}


def workload(striped: DataFrame, column: str, case: str, lookups: int) -> dict[str, DataFrame]:
    """The lookups of a case by name; `mixed` gives eleven, from no to only positive ones."""
    plain = {"positive_uniform": positive_uniform, "positive_distinct": positive_distinct, "positive_zipf": positive_zipf, "negative": negative}
    if case == "mixed":
        return {f"mixed/{t / 10:.1f}": keys for t, keys in mixed(striped, column, lookups).items()}
    if case not in plain:
        raise ValueError(f"unknown test case: {case}")
    return {case: plain[case](striped, column, lookups)}


def held_of(striped: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """(value, stripe_id) that hold the values (value), which are few, in their type."""
    true = truth.pairs(striped.select(F.col(column).cast(values.schema["value"].dataType).alias("value"), "stripe_id").join(values, "value", "left_semi"), "value")
    return true.select("value", "stripe_id")


def _answered(found: DataFrame, true: DataFrame) -> DataFrame:
    """(value, true, extra, missed): how many stripes hold a value, are given in vain, are missed."""
    sides = found.select("value", "stripe_id", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(
        true.select("value", "stripe_id", F.lit(0).alias("f"), F.lit(1).alias("t"))
    )
    cells = sides.groupBy("value", "stripe_id").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    return cells.groupBy("value").agg(
        F.sum("t").alias("true"), F.count_if((F.col("f") == 1) & (F.col("t") == 0)).alias("extra"), F.count_if((F.col("f") == 0) & (F.col("t") == 1)).alias("missed")
    )


def _counted(num_stripes: int) -> list[Column]:
    """The counts of an outcome, over lookups (times) beside what they were answered."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        zero(F.sum("times")).alias("num_lookups"),
        zero(F.sum(F.col("times") * zero(F.col("extra")))).alias("num_false_positives"),
        zero(F.sum(F.col("times") * (num_stripes - zero(F.col("true"))))).alias("num_true_negatives"),
        zero(F.sum(F.col("times") * zero(F.col("missed")))).alias("num_false_negatives"),
    ]


def outcome(found: DataFrame, striped: DataFrame, column: str, lookups: DataFrame, num_stripes: int) -> DataFrame:
    """One row: num_lookups, num_false_positives, num_true_negatives, num_false_negatives.

    found: (value, stripe_id) that an index gives for the distinct values of lookups. Stripes
    without the value count as true negatives, also where the index gave them, and those as
    false positives too. Counted from set sizes; lookups and stripes are never crossed."""
    times = lookups.groupBy("value").agg(F.count("*").alias("times"))
    true = held_of(striped, column, times.select("value"))
    return times.join(_answered(found, true), "value", "left").agg(*_counted(num_stripes))


def outcomes(found: DataFrame, true: DataFrame, lookups: DataFrame, num_stripes: int) -> DataFrame:
    """outcome by test, of lookups (test, value) of several tests at once: a row for each test that
    has lookups. true: held_of their values."""
    times = lookups.groupBy("test", "value").agg(F.count("*").alias("times"))
    return times.join(_answered(found, true), "value", "left").groupBy("test").agg(*_counted(num_stripes))


@dataclass(frozen=True)
class Built:
    """An index ready to be asked: candidates(probes) -> (value, stripe_id), and its bytes."""

    name: str
    candidates: Callable[[DataFrame], DataFrame]
    byte_size: int
    compressed_size: int


Builder = Callable[[DataFrame, str, int], Built]


def zone_map_builder() -> Builder:
    def make(striped: DataFrame, column: str, num_stripes: int) -> Built:
        zones = kept(zonemap.build(striped, column))
        raw, packed = zonemap.sizes(zones)
        return Built(zonemap.NAME, lambda p: zonemap.candidates(zones, p), raw, packed)

    return make


def bloom_builder(bits: int = 10, name: str | None = None, stripes: DataFrame | None = None) -> Builder:
    """stripes: the table's bloom.by_stripe, where it is there already."""

    def make(striped: DataFrame, column: str, num_stripes: int) -> Built:
        hashes = kept(bloom.by_stripe(striped, column)) if stripes is None else stripes
        s, blocked = bloom.sizes_from(hashes, bits).first(), bloom.blocks(bloom.build_from(hashes, bits))
        return Built(name or f"PerStripeBloom/{bits}", lambda p: bloom.candidates_in(blocked, p, bits), s[0] or 0, s[1] or 0)

    return make


def xor_builder() -> Builder:
    def make(striped: DataFrame, column: str, num_stripes: int) -> Built:
        filters = kept(xor8.build(striped, column))
        s = xor8.sizes(filters).first()
        return Built(xor8.NAME, lambda p: xor8.candidates(filters, p), s[0] or 0, s[1] or 0)

    return make


Placing = Callable[[DataFrame, str, int], cuckoo.Placed]


def cuckoo_builder(config: cuckoo.Config = cuckoo.Config(), placing: Placing | None = None) -> Builder:
    """placing: gives the table's values placed, where several indexes share them."""

    def make(striped: DataFrame, column: str, num_stripes: int) -> Built:
        from stripewise.functions.index_bytes import encoded_size

        placed = placing(striped, column, num_stripes) if placing else None
        index = cuckoo.build(striped, column, num_stripes, config, cuckoo.SHARD_VALUES, placed)
        raw, packed = encoded_size(index)
        return Built(config.name, lambda p: cuckoo.candidates(index, p), raw, packed)

    return make


def stripe_hashes(striped: DataFrame, column: str, num_stripes: int) -> DataFrame:
    return kept(bloom.by_stripe(striped, column))


def comparable_bloom_builder(other: Builder, hashes: Callable[[DataFrame, str, int], DataFrame] = stripe_hashes) -> Builder:
    """Bloom filters as large as another index."""

    def make(striped: DataFrame, column: str, num_stripes: int) -> Built:
        target, stripes = other(striped, column, num_stripes), hashes(striped, column, num_stripes)
        bits = bloom.comparable_bits_from(stripes, target.compressed_size)
        return bloom_builder(bits, f"PerStripeBloomComparableSize/{target.name}", stripes)(striped, column, num_stripes)

    return make


def once[T](builder: Callable[[DataFrame, str, int], T]) -> Callable[[DataFrame, str, int], T]:
    """builder, which gives its last index again where the same is asked for."""
    last: list = []

    def make(striped: DataFrame, column: str, num_stripes: int) -> T:
        if not last or last[0] is not striped or last[1:3] != [column, num_stripes]:
            last[:] = [striped, column, num_stripes, builder(striped, column, num_stripes)]
        return last[3]

    return make


def usual_builders() -> list[Builder]:
    """Both hash indexes share their values' places, both Bloom filters the values' hashes."""
    placing, hashes = once(lambda striped, column, _: cuckoo.place(striped, column)), once(stripe_hashes)
    low, high = (once(cuckoo_builder(cuckoo.Config(scan_rate=rate), placing)) for rate in (0.001, 0.01))
    return [low, comparable_bloom_builder(low, hashes), high, comparable_bloom_builder(high, hashes), xor_builder(), zone_map_builder()]


def bitmap_stats(striped: DataFrame, column: str, num_stripes: int) -> dict[str, float]:
    """Measures of the column's stripe bitmaps laid end to end by value, from their ones."""
    sets = kept(truth.value_stripes(striped, column).withColumnRenamed("value", "bitmap_id"))
    m = global_measures(sets, num_stripes).first()
    sizes = codec_sizes(sets, num_stripes).first().asDict()
    plain = {"density": m["density"], "clustering": m["clustering"], "bitpacked_size": bitpacked_size(m["bitmaps"], num_stripes)}
    return {f"bitmap_{name}": value for name, value in (plain | sizes).items()}


OUTCOME = ("num_lookups", "num_false_positives", "num_true_negatives", "num_false_negatives")


def _asked(striped: DataFrame, column: str, tests: dict[str, DataFrame]) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The lookups (test, value) of all tests whose values have one type, their distinct values, and
    the stripes that hold them; computed once for all indexes."""
    kinds: dict[str, DataFrame] = {}
    for name, keys in tests.items():
        keys, kind = keys.select(F.lit(name).alias("test"), "value"), keys.schema["value"].dataType.simpleString()
        kinds[kind] = kinds[kind].unionByName(keys) if kind in kinds else keys
    out = []
    for keys in kinds.values():
        keys = kept(keys)
        values = kept(keys.select("value").distinct())
        out.append((keys, values, kept(held_of(striped, column, values))))
    return out


def experiments(
    assign: Callable[[int], tuple[DataFrame, int]],
    columns: Sequence[str],
    stripe_sizes: Sequence[int],
    builders: Sequence[Builder],
    cases: Sequence[str],
    lookups: int,
    phases: Phases | None = None,
) -> DataFrame:
    """The grid of columns, stripe sizes, indexes and cases: a row each, with the columns of
    REPORT. assign gives the striped table and its number of stripes for a stripe size. A false
    negative is an error. phases counts the time of measures, builds and lookups."""
    rows, spark, phases = [], None, phases or Phases()
    for size in stripe_sizes:
        striped, n = assign(size)
        spark = striped.sparkSession
        for column in columns:
            kind = "STRING" if dict(striped.dtypes)[column] == "string" else "INT"
            with phases.phase("measures"):
                cardinality = striped.agg(F.count_distinct(column)).first()[0]
                packed = compressed_size(striped, column).first()[0]
                stats = bitmap_stats(striped, column, n)
            tests = {k: kept(v) for case in cases for k, v in workload(striped, column, case, lookups).items()}
            asked = _asked(striped, column, tests)
            for builder in builders:
                with phases.phase("builds"):
                    built = builder(striped, column, n)
                with phases.phase(f"lookups {built.name}"):
                    met = {o["test"]: tuple(o)[1:] for keys, values, true in asked for o in outcomes(built.candidates(values), true, keys, n).collect()}
                for name in tests:
                    o = dict(zip(OUTCOME, met.get(name, (0, 0, 0, 0)), strict=True))
                    if o["num_false_negatives"]:
                        raise AssertionError(f"{built.name} missed {o['num_false_negatives']} stripes of {column}")
                    known = {
                        "index_structure": built.name, "num_rows_per_stripe": size, "num_stripes": n, "column_name": column, "column_type": kind,
                        "column_cardinality": cardinality, "column_compressed_size_bytes": packed, "index_size_bytes": built.byte_size,
                        "index_compressed_size_bytes": built.compressed_size, "test_case": name,
                    } | o | stats
                    rows.append(tuple(_typed(known.get(c.partition(":")[0]), c.partition(":")[2]) for c in REPORT))
    schema = ", ".join(f"{c.partition(':')[0]} {c.partition(':')[2].replace('INT', 'BIGINT')}" for c in REPORT)
    if spark is None:
        raise ValueError("no stripe sizes")
    return spark.createDataFrame(rows, schema)


def _typed(value, kind: str):
    if kind == "STRING":
        return value
    return float(value or 0) if kind == "DOUBLE" else int(value or 0)


def summary(results: DataFrame) -> DataFrame:
    """Per index, column and stripe size: index size against the column's in percent, and the
    scan rate on absent values in percent (-1 where there was no such case)."""
    rate = 100 * F.col("num_false_positives") / (F.col("num_lookups") * F.col("num_stripes"))
    negative_rate = F.max(F.when(F.col("test_case") == "negative", rate))
    return results.groupBy("index_structure", "column_name", "num_rows_per_stripe").agg(
        F.max("column_compressed_size_bytes").alias("column_bytes"),
        F.max("index_compressed_size_bytes").alias("index_bytes"),
        F.round(F.max(100 * F.col("index_compressed_size_bytes") / F.col("column_compressed_size_bytes")), 4).alias("relative_size_percent"),
        F.round(F.coalesce(negative_rate, F.lit(-1.0)), 4).alias("scan_rate_percent"),
    )


def write_report(results: DataFrame, path: str) -> None:
    """One CSV file with a header of `name:type`; a report is a few rows."""
    named = results.select(*[F.col(c.partition(":")[0]).alias(c) for c in REPORT])
    named.coalesce(1).write.mode("overwrite").csv(path, header=True)
