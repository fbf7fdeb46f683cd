"""One Xor filter with 8-bit fingerprints per stripe (Graf and Lemire, 2020)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.functions.codecs import compress
from stripewise.functions.hashing import hash64
from stripewise.operators import truth

NAME = "PerStripeXor"
HEADER = 8  # bytes: the seed, and the length of a third


def _places(keys: np.ndarray, seed: int, third: int) -> tuple[np.ndarray, np.ndarray]:
    """Three places of each key, one in each third, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
        h ^= h >> np.uint64(33)
        low = np.uint64(0xFFFFFFFF)
        turn = lambda r: ((h << np.uint64(r)) | (h >> np.uint64(64 - r))) & low if r else h & low
        at = np.stack([(turn(r) * np.uint64(third)) >> np.uint64(32) for r in (0, 21, 42)])
    at += np.arange(3, dtype=np.uint64)[:, None] * np.uint64(third)
    return at.astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """Seed, length of a third, fingerprints. Keys are 64-bit and distinct. Places used by one
    key alone are peeled off round by round; seeds are tried until no key is left."""
    third = max(2, int(32 + 1.23 * len(keys)) // 3 + 1)
    for seed in range(1, 1000):
        at, fp = _places(keys, seed, third)
        count = np.bincount(at.ravel(), minlength=3 * third)
        mark = np.zeros(3 * third, np.int64)
        for row in at:
            np.bitwise_xor.at(mark, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            who, first = np.unique(mark[alone], return_index=True)
            if not len(who):
                break
            rounds.append((who, alone[first]))
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(mark, row, who)
            left -= len(who)
        if not left:
            table = np.zeros(3 * third, np.uint8)
            for who, own in reversed(rounds):
                a, b, c = at[:, who]
                table[own] = 0
                table[own] = fp[who] ^ table[a] ^ table[b] ^ table[c]
            return seed.to_bytes(4, "little") + third.to_bytes(4, "little") + table.tobytes()
    raise RuntimeError("no seed peels these keys; are they distinct?")


def filter_contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, third = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    (a, b, c), fp = _places(keys, seed, third)
    table = np.frombuffer(data, np.uint8, offset=HEADER)
    return fp == table[a] ^ table[b] ^ table[c]


def build(striped: DataFrame, column: str) -> DataFrame:
    """(stripe_id, payload): a filter for each stripe's distinct values. A task holds one
    stripe's hashes at a time."""
    keys = truth.pairs(striped, column).select("stripe_id", hash64(5, F.col("value")).alias("h")).distinct()

    def make(group: pd.DataFrame) -> pd.DataFrame:
        h = np.sort(group["h"].to_numpy()).view(np.uint64)
        return pd.DataFrame({"stripe_id": group["stripe_id"].iloc[:1], "payload": [build_filter(h)]})

    return keys.groupBy("stripe_id").applyInPandas(make, "stripe_id int, payload binary")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _contain(payload: pd.Series, hashes: pd.Series) -> pd.Series:
    return pd.Series([filter_contains(p, np.asarray(h, np.int64).view(np.uint64)).tolist() for p, h in zip(payload, hashes, strict=True)])


def candidates(filters: DataFrame, probes: DataFrame, block: int = 10_000) -> DataFrame:
    """(value, stripe_id) that the filters let through; probes (value) go to every stripe in
    blocks, so that a filter is read once per block and not once per probe."""
    values = probes.select("value").where(F.col("value").isNotNull()).distinct()
    n = max(1, -(-values.count() // block))
    blocks = values.withColumn("h", hash64(5, F.col("value"))).groupBy(F.pmod("h", F.lit(n)).alias("part"))
    blocks = blocks.agg(F.collect_list(F.struct("value", "h")).alias("p"))
    asked = blocks.join(filters).select("stripe_id", "p", _contain("payload", F.col("p.h")).alias("in"))
    pair = F.explode(F.arrays_zip(F.col("p.value").alias("value"), F.col("in").alias("maybe"))).alias("x")
    return asked.select("stripe_id", pair).where("x.maybe").select("x.value", "stripe_id")


def sizes(filters: DataFrame) -> DataFrame:
    """One row: byte_size, and compressed_size stripe by stripe."""

    @F.pandas_udf(T.LongType())
    def packed(data: pd.Series) -> pd.Series:
        return data.map(lambda d: len(compress(d)))

    each = filters.select(F.length("payload").cast("long").alias("raw"), packed("payload").alias("packed"))
    return each.agg(F.sum("raw").alias("byte_size"), F.sum("packed").alias("compressed_size"))
