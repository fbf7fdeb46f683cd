"""The hash index: one table of short fingerprints, each with the stripes of its value.

Values are dealt into shards by hash; each shard is a cuckoo table of its own, filled by one
task. What is stored of a value is only as many bits of its fingerprint as tell it from all
others that may be looked for in its bucket, and as many more as keep the share of stripes read
in vain for absent values under the scan rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.functions.hashing import (
    BUCKET_SEEDS,
    FINGERPRINT_SEED,
    SHARD_SEED,
    collision_free_bits,
    fingerprint_bits,
    hash64,
    scan_rate_bits,
)
from stripewise.operators import truth
from stripewise.session import kept

# Usual load factors and weights of skewed kicking, by slots per bucket.
LOAD_FACTOR = {1: 0.49, 2: 0.84, 4: 0.95, 8: 0.98}
SKEW = {1: 1.1, 2: 16.0, 4: 128.0, 8: 1024.0}
MOST_KICKS = 50_000
GROWTH = 1.01
SHARD_VALUES = 200_000


class Algorithm(Enum):
    KICKING = 0
    SKEWED_KICKING = 1
    MATCHING = 2


def min_buckets(num_values: int, slots: int, load_factor: float | None = None) -> int:
    """Buckets that hold the values at no more than the load factor."""
    if load_factor is None:
        if slots not in LOAD_FACTOR:
            raise ValueError("slots per bucket must be 1, 2, 4 or 8")
        load_factor = LOAD_FACTOR[slots]
    return math.ceil(num_values / load_factor / slots)


def next_buckets(buckets: int) -> int:
    return max(int(buckets * GROWTH), buckets + 1)


class Table:
    """A cuckoo table of value numbers, filled by kicking residents to their other bucket."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int, slots: int, skewed: bool, seed: int = 42) -> None:
        self.first, self.second, self.slots, self.skewed = first.tolist(), second.tolist(), slots, skewed
        self.rows: list[list[int]] = [[] for _ in range(buckets)]
        self.random = np.random.default_rng(seed)
        self.bits: list[float] = []

    def _chance(self) -> float:
        if not self.bits:
            self.bits = self.random.random(4096).tolist()
        return self.bits.pop()

    def _victim(self, value: int) -> tuple[int, int]:
        """The bucket and slot to take. Skewed: the more, the rather a resident that is not in
        its first bucket; moving it can only bring it home."""
        one, two = self.first[value], self.second[value]
        if self.skewed:
            away = [(b, i) for b in (one, two) for i, v in enumerate(self.rows[b]) if self.first[v] != b]
            home = 2 * self.slots - len(away)
            if away and home:
                weight = len(away) / home * SKEW[self.slots]
                if self._chance() < weight / (weight + 1):
                    return away[int(self._chance() * len(away))]
                rest = [(b, i) for b in (one, two) for i, v in enumerate(self.rows[b]) if self.first[v] == b]
                return rest[int(self._chance() * len(rest))]
        return (one if self._chance() < 0.5 else two), int(self._chance() * self.slots)

    def insert(self, value: int, most_kicks: int = MOST_KICKS) -> bool:
        for _ in range(most_kicks + 1):
            for b in (self.first[value], self.second[value]):
                if len(self.rows[b]) < self.slots:
                    self.rows[b].append(value)
                    return True
            b, i = self._victim(value)
            self.rows[b][i], value = value, self.rows[b][i]
        return False


def distribute(
    first: np.ndarray, second: np.ndarray, buckets: int, slots: int, skewed: bool, most_kicks: int = MOST_KICKS
) -> list[list[int]] | None:
    """The buckets' values, or none if a value finds no place. As many as their first buckets hold
    are put there at once; the others are inserted one by one and kick where they must."""
    table = Table(first, second, buckets, slots, skewed)
    order = np.argsort(first, kind="stable")
    home = np.asarray(first)[order]
    fits = np.arange(len(home)) - np.searchsorted(home, home) < slots
    for b, v in zip(home[fits].tolist(), order[fits].tolist(), strict=True):
        table.rows[b].append(v)
    if all(table.insert(v, most_kicks) for v in order[~fits].tolist()):
        return table.rows
    return None


@dataclass(frozen=True)
class Config:
    slots: int = 1
    load_factor: float | None = None
    scan_rate: float = 0.01
    algorithm: Algorithm = Algorithm.SKEWED_KICKING
    prefix_bits: bool = False

    @property
    def name(self) -> str:
        load = self.load_factor or LOAD_FACTOR[self.slots]
        return f"CuckooTable:{self.algorithm.value}:{load:g}:{self.scan_rate:g}"


@dataclass(frozen=True)
class Index:
    """slots: shard, bucket, slot, num_bits, use_prefix, fp, stripes. shards: shard, buckets.
    Both are DataFrames, to be kept as tables."""

    slots: DataFrame
    shards: DataFrame
    num_shards: int
    num_stripes: int
    config: Config


def _hashed(values: DataFrame, num_shards: int) -> DataFrame:
    v = F.col("value")
    return values.select(
        "*",
        F.pmod(hash64(SHARD_SEED, v), F.lit(num_shards)).cast("int").alias("shard"),
        F.shiftrightunsigned(hash64(BUCKET_SEEDS[0], v), 1).alias("h1"),
        F.shiftrightunsigned(hash64(BUCKET_SEEDS[1], v), 1).alias("h2"),
        hash64(FINGERPRINT_SEED, v).alias("fp"),
    )


@dataclass(frozen=True)
class Placed:
    """Values in their buckets, before fingerprints are cut: hashed values with their stripe sets,
    homes (shard, buckets, h1, h2, fp, bucket, slot, first), and the number of shards. The scan rate
    has no part in it."""

    hashed: DataFrame
    homes: DataFrame
    num_shards: int


def place(striped: DataFrame, column: str, config: Config = Config(), shard_values: int = SHARD_VALUES) -> Placed:
    """The values of a striped table's column, placed; a shard takes about shard_values values."""
    if config.algorithm is Algorithm.MATCHING:
        raise NotImplementedError("matching has no implementation; use a kicking algorithm")
    if config.slots not in LOAD_FACTOR:
        raise ValueError("slots per bucket must be 1, 2, 4 or 8")
    sets = kept(truth.value_stripes(striped, column))
    num_shards = max(1, -(-sets.count() // shard_values))
    hashed = _hashed(sets, num_shards)
    slots, load, skewed = config.slots, config.load_factor, config.algorithm is Algorithm.SKEWED_KICKING

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h1", "h2", "fp"], ignore_index=True)  # the same in every run
        h1, h2 = group["h1"].to_numpy(), group["h2"].to_numpy()
        buckets = max(1, min_buckets(len(group), slots, load))
        while True:
            first, second = h1 % buckets, h2 % buckets
            rows = distribute(first, second, buckets, slots, skewed)
            if rows is not None:
                break
            buckets = next_buckets(buckets)
        order = [(v, b, i) for b, r in enumerate(rows) for i, v in enumerate(r)]
        at = np.array([v for v, _, _ in order])
        return pd.DataFrame(
            {
                "shard": group["shard"].to_numpy()[at],
                "buckets": buckets,
                "h1": group["h1"].to_numpy()[at],
                "h2": group["h2"].to_numpy()[at],
                "fp": group["fp"].to_numpy()[at],
                "bucket": [b for _, b, _ in order],
                "slot": [i for _, _, i in order],
                "first": first[at],
            }
        )

    schema = "shard int, buckets long, h1 long, h2 long, fp long, bucket long, slot int, first long"
    return Placed(hashed, kept(hashed.select("shard", "h1", "h2", "fp").groupBy("shard").applyInPandas(fill, schema)), num_shards)


def build(
    striped: DataFrame, column: str, num_stripes: int, config: Config = Config(), shard_values: int = SHARD_VALUES, placed: Placed | None = None
) -> Index:
    """The index of a striped table's column; a shard takes about shard_values values. placed: what
    place() gave for the same table and a config that differs in the scan rate or prefixes alone."""
    placed = placed or place(striped, column, config, shard_values)
    hashed, homes, num_shards = placed.hashed, placed.homes, placed.num_shards

    # Fingerprints that a lookup may meet in a bucket: residents, and values kicked out of it.
    met = homes.select("shard", "bucket", "fp").unionByName(
        homes.where("bucket <> first").select("shard", F.col("first").alias("bucket"), "fp")
    )
    met = met.groupBy("shard", "bucket").agg(F.collect_list("fp").alias("fps"))
    low, high = collision_free_bits(F.col("fps")), collision_free_bits(F.col("fps"), use_prefix=True)
    needs = met.select("shard", "bucket", low.alias("low"), high.alias("high"))
    use_prefix = (F.col("low") > 1) & (F.col("low") > F.col("high")) if config.prefix_bits else F.lit(False)
    needs = needs.withColumn("use_prefix", use_prefix).withColumn("least", F.when(F.col("use_prefix"), F.col("high")).otherwise(F.col("low")))

    stripes = hashed.select("shard", "h1", "h2", "fp", "stripes")
    filled = homes.join(stripes, ["shard", "h1", "h2", "fp"])
    ones = F.avg(F.size("stripes") / F.lit(max(1, num_stripes)))
    per_bucket = filled.groupBy("shard", "bucket").agg(ones.alias("mean_ones"))
    density = homes.groupBy("shard").agg((F.count_distinct("bucket") / F.max("buckets")).alias("density"))
    bits = (
        per_bucket.join(needs, ["shard", "bucket"])
        .join(density, "shard")
        .select("shard", "bucket", "use_prefix", scan_rate_bits(F.col("least"), F.col("density"), F.col("mean_ones"), config.scan_rate).alias("num_bits"))
    )
    stored = filled.join(bits, ["shard", "bucket"]).select(
        "shard", "bucket", "slot", "num_bits", "use_prefix", fingerprint_bits(F.col("fp"), F.col("num_bits"), F.col("use_prefix")).alias("fp"), "stripes"
    )
    shards = homes.groupBy("shard").agg(F.max("buckets").alias("buckets"))
    return Index(kept(stored), kept(shards), num_shards, num_stripes, config)


def lookup(index: Index, probes: DataFrame) -> DataFrame:
    """(value, stripes) for each distinct probe (value): exact for values that occur, maybe too
    many stripes for others. The first bucket answers before the second is asked: a value that
    was kicked out matches nothing in its first."""
    values = probes.select("value").distinct()
    asked = _hashed(values.where(F.col("value").isNotNull()), index.num_shards).join(index.shards, "shard", "left")
    home = lambda rank, h: F.struct(F.lit(rank).alias("rank"), (F.col(h) % F.col("buckets")).alias("bucket"))
    both = asked.select("value", "shard", F.col("fp").alias("probe_fp"), F.explode(F.array(home(0, "h1"), home(1, "h2"))).alias("b"))
    both = both.select("value", "shard", "probe_fp", "b.rank", "b.bucket")
    met = both.join(index.slots, ["shard", "bucket"], "left")
    hit = fingerprint_bits(F.col("probe_fp"), F.col("num_bits"), F.col("use_prefix")) == F.col("fp")
    none = F.array().cast("array<int>")
    found = met.groupBy("value").agg(F.coalesce(F.min_by("stripes", F.when(hit, F.col("rank"))), none).alias("stripes"))
    return found.unionByName(values.where(F.col("value").isNull()).select("value", none.alias("stripes")))


def save(index: Index, path: str) -> None:
    """The index as tables under path; load() reads it in another session."""
    spark, config = index.slots.sparkSession, index.config
    index.slots.repartition("shard").sortWithinPartitions("shard", "bucket", "slot").write.mode("overwrite").parquet(f"{path}/slots")
    index.shards.write.mode("overwrite").parquet(f"{path}/shards")
    row = (index.num_shards, index.num_stripes, config.slots, config.load_factor, config.scan_rate, config.algorithm.value, config.prefix_bits)
    names = "num_shards int, num_stripes int, slots int, load_factor double, scan_rate double, algorithm int, prefix_bits boolean"
    spark.createDataFrame([row], names).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load(spark: SparkSession, path: str) -> Index:
    """The index that save() wrote."""
    row = spark.read.parquet(f"{path}/config").first()
    config = Config(row["slots"], row["load_factor"], row["scan_rate"], Algorithm(row["algorithm"]), row["prefix_bits"])
    return Index(spark.read.parquet(f"{path}/slots"), spark.read.parquet(f"{path}/shards"), row["num_shards"], row["num_stripes"], config)


def stats(index: Index) -> DataFrame:
    """A row for each number of values that a bucket holds, 0 included: buckets, and their share."""
    held = index.slots.groupBy("shard", "bucket").agg(F.count("*").alias("held")).groupBy("held").agg(F.count("*").alias("buckets"))
    full = held.agg(F.sum("buckets").alias("n"))
    total = index.shards.agg(F.sum("buckets").alias("total"))
    empty = total.crossJoin(full).select(F.lit(0).cast("long").alias("held"), (F.col("total") - F.coalesce("n", F.lit(0))).alias("buckets"))
    return held.unionByName(empty).crossJoin(total).select("held", "buckets", (F.col("buckets") / F.col("total")).alias("share"))


def candidates(index: Index, probes: DataFrame) -> DataFrame:
    """(value, stripe_id) of a lookup."""
    return lookup(index, probes).select("value", F.explode("stripes").alias("stripe_id"))


def active_slots(index: Index) -> int:
    return index.slots.count()


def same_length(slots: DataFrame) -> DataFrame:
    """(shard, bucket) whose slots differ in length: there must be none."""
    return slots.groupBy("shard", "bucket").agg(F.count_distinct("num_bits").alias("n")).where("n > 1").select("shard", "bucket")


def blocks(index: Index) -> DataFrame:
    """(num_bits, buckets, fingerprints): the buckets by the length of their fingerprints, that of
    most buckets first; empty buckets have length 0."""
    by_length = index.slots.groupBy("num_bits").agg(
        F.count_distinct("shard", "bucket").alias("buckets"), F.count("*").alias("fingerprints")
    )
    used = by_length.agg(F.coalesce(F.sum("buckets"), F.lit(0)).alias("used"))
    empty = index.shards.agg(F.sum("buckets").alias("total")).crossJoin(used).where("total > used")
    empty = empty.select(F.lit(0).alias("num_bits"), (F.col("total") - F.col("used")).alias("buckets"), F.lit(0).cast("long").alias("fingerprints"))
    return by_length.unionByName(empty).orderBy(F.desc("buckets"), "num_bits")
