"""One Bloom filter per stripe, as words of bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.functions.codecs import compress
from stripewise.functions.hashing import hash64, md5_hash
from stripewise.operators import truth
from stripewise.session import kept

LEAST_BITS = 64


def num_probes(bits_per_key: int) -> int:
    """Hash functions: 69 % of the bits per key, from 1 to 30."""
    return min(30, max(1, int(bits_per_key * 0.69)))


def _hashes(value: Column, md5: bool) -> tuple[Column, Column]:
    """Two hashes under 2**31; md5 where another engine must agree."""
    if md5:
        return md5_hash(1, value) % (1 << 31), md5_hash(2, value) % (1 << 31)
    return F.pmod(hash64(1, value), F.lit(1 << 31)), F.pmod(hash64(2, value), F.lit(1 << 31))


def _positions(value: Column, m: Column, k: int, md5: bool) -> Column:
    """The k positions of a value by double hashing."""
    one, two = _hashes(value, md5)
    return F.array(*[F.pmod(one + i * two, m).cast("int") for i in range(k)])


def positions(striped: DataFrame, column: str, bits_per_key: int = 10, md5: bool = False) -> DataFrame:
    """Distinct (stripe_id, m, pos): the bits set in each stripe's filter of m bits."""
    values = truth.pairs(striped, column)
    sizes = values.groupBy("stripe_id").agg(F.greatest(F.lit(LEAST_BITS), F.count("*") * bits_per_key).alias("m"))
    at = _positions(F.col("value"), F.col("m"), num_probes(bits_per_key), md5).alias("at")
    each = values.join(sizes, "stripe_id").select("stripe_id", "m", at).select("stripe_id", "m", F.explode("at").alias("pos"))
    return each.distinct()


def by_stripe(striped: DataFrame, column: str, md5: bool = False) -> DataFrame:
    """(stripe_id, one, two): the two hashes of each of a stripe's distinct values. All that filters
    of any number of bits are made of, so that values are shuffled and hashed once."""
    one, two = (h.cast("int") for h in _hashes(F.col("value"), md5))
    values = truth.pairs(striped, column).select("stripe_id", one.alias("one"), two.alias("two"))
    return values.groupBy("stripe_id").agg(F.collect_list("one").alias("one"), F.collect_list("two").alias("two"))


def _filter(one: np.ndarray, two: np.ndarray, bits_per_key: int) -> tuple[int, np.ndarray]:
    """A stripe's filter: its length in bits, and its words."""
    m = max(LEAST_BITS, len(one) * bits_per_key)
    bits = np.zeros(-(-m // 64) * 64, np.uint8)
    at, two = one.astype(np.int64), two.astype(np.int64)
    for _ in range(num_probes(bits_per_key)):
        bits[at % m] = 1
        at += two
    return m, np.packbits(bits, bitorder="little").view("<i8")


def _filters(batches: Iterator[pa.RecordBatch], bits_per_key: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The stripe, length and words of each filter of by_stripe's batches."""
    for b in batches:
        for i in range(b.num_rows):
            yield b["stripe_id"][i].as_py(), *_filter(*[b[c][i].values.to_numpy() for c in ("one", "two")], bits_per_key)


def build(striped: DataFrame, column: str, bits_per_key: int = 10, md5: bool = False) -> DataFrame:
    """(stripe_id, m, word, bits): the filters in words of 64 bits; words of zeros are left out."""
    return build_from(by_stripe(striped, column, md5), bits_per_key)


def build_from(stripes: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """build from the hashes of by_stripe; a task holds one stripe's filter at a time."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, m, bits in _filters(batches, bits_per_key):
            at = np.flatnonzero(bits)
            columns = [np.full(len(at), stripe, np.int32), np.full(len(at), m), at, bits[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["stripe_id", "m", "word", "bits"])

    return stripes.mapInArrow(words, "stripe_id int, m long, word long, bits long")


def sizes_from(stripes: DataFrame, bits_per_key: int) -> DataFrame:
    """sizes of the filters that build_from makes; only their sizes leave a task."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = packed = 0
        for _, m, bits in _filters(batches, bits_per_key):
            data = bits.tobytes()[: -(-m // 8)]
            raw, packed = raw + len(data), packed + len(compress(data))
        yield pa.RecordBatch.from_pydict({"raw": [raw], "packed": [packed]})

    each = stripes.mapInArrow(squeeze, "raw long, packed long")
    return each.agg(F.sum("raw").alias("byte_size"), F.sum("packed").alias("compressed_size"))


def _whole(words: np.ndarray, bits: np.ndarray, m: int) -> np.ndarray:
    """A filter's words in place, those left out as zeros."""
    out = np.zeros(-(-m // 64), np.uint64)
    out[words] = bits.view(np.uint64)
    return out


def contains(words: np.ndarray, m: int, one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
    """Whether all k bits of each probe (its two hashes) are set in a filter; a probe that one
    bit settles is not looked at again."""
    left = np.arange(len(one))
    for i in range(k):
        at = (one[left] + i * two[left]) % m
        left = left[(words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    out = np.zeros(len(one), bool)
    out[left] = True
    return out


#: Probes of a chunk, probes looked up at a time, and chunks and blocks that one task meets.
CHUNK, AT_ONCE, CHUNKS, BLOCKS = 1 << 15, 1 << 13, 8, 4


def _in_block(m: Column) -> Column:
    """Filters of m bits laid side by side: as many as keep their block at a few megabytes."""
    return F.when(m <= 1 << 17, 512).when(m <= 1 << 20, 64).otherwise(8)


def blocks(filters: DataFrame) -> DataFrame:
    """(m, block, stripes, words, bits): the filters of equal length together, a few hundred each.
    Computed once; a probe has the same positions in all filters of a block."""
    stripe = filters.groupBy("m", "stripe_id").agg(F.collect_list("word").alias("words"), F.collect_list("bits").alias("bits"))
    stripe = kept(stripe)
    counts = stripe.groupBy("m").agg(F.ceil(F.count("*") / _in_block(F.col("m"))).alias("n"))
    dealt = stripe.join(counts, "m").withColumn("block", F.pmod(F.xxhash64("stripe_id"), F.col("n")))
    each = [F.collect_list(c).alias(name) for c, name in (("stripe_id", "stripes"), ("words", "words"), ("bits", "bits"))]
    return kept(dealt.groupBy("m", "block").agg(*each))


def _side_by_side(words: list[np.ndarray], bits: list[np.ndarray], m: int) -> np.ndarray:
    """A row of bits for each position, one bit a filter, in words of 64 (of 8 for up to 8)."""
    width = 1 if len(words) <= 8 else -(-len(words) // 64) * 8
    out = np.zeros((m, width), np.uint8)
    for j, (w, b) in enumerate(zip(words, bits, strict=True)):
        at = np.flatnonzero(np.unpackbits(_whole(w, b, m).view(np.uint8), bitorder="little"))
        out[at, j >> 3] |= np.uint8(1 << (j & 7))
    return out if width == 1 else out.view(np.uint64)


def _hits(rows: np.ndarray, m: int, one: np.ndarray, two: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe, filter) of the probes that all k rows of bits leave."""
    left = rows[one % m]
    for i in range(1, k):
        left &= rows[(one + i * two) % m]
    octets = np.ascontiguousarray(left).view(np.uint8)
    at = np.flatnonzero(octets)
    bit = np.flatnonzero(np.unpackbits(octets.ravel()[at], bitorder="little"))
    where = at[bit >> 3]
    return where // octets.shape[1], (where % octets.shape[1]) * 8 + (bit & 7)


def candidates(filters: DataFrame, probes: DataFrame, bits_per_key: int = 10, md5: bool = False, block: int = CHUNK) -> DataFrame:
    """(value, stripe_id) where all bits of the probe (value) are set."""
    return candidates_in(blocks(filters), probes, bits_per_key, md5, block)


def candidates_in(blocked: DataFrame, probes: DataFrame, bits_per_key: int = 10, md5: bool = False, block: int = CHUNK) -> DataFrame:
    """candidates of the filters of blocks(). Every probe asks every stripe, but those whose filters
    are equally long (as many lengths as a stripe has rows, at most) at once: one and of rows of
    bits answers for 64 stripes. Blocks meet chunks of probes, and only hits become rows."""
    k = num_probes(bits_per_key)
    values = kept(probes.select("value").where(F.col("value").isNotNull()).distinct())
    one, two = _hashes(F.col("value"), md5)
    n = max(1, -(-values.count() // block))
    chunks = values.select("value", one.alias("one"), two.alias("two")).groupBy(F.pmod(F.xxhash64("value"), F.lit(n)).alias("part")).agg(
        F.collect_list("value").alias("values"), F.collect_list("one").alias("one"), F.collect_list("two").alias("two")
    )
    kind = values.schema["value"].dataType.simpleString()

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, stripes = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                m, number = b["m"][i].as_py(), b["block"][i].as_py()
                if (m, number) != last:
                    last, stripes = (m, number), b["stripes"][i].values.to_numpy()
                    rows = _side_by_side(*[[x.values.to_numpy() for x in b[c][i]] for c in ("words", "bits")], m)
                values, one, two = b["values"][i].values, b["one"][i].values.to_numpy(), b["two"][i].values.to_numpy()
                for start in range(0, len(one), AT_ONCE):
                    probe, stripe = _hits(rows, m, one[start : start + AT_ONCE], two[start : start + AT_ONCE], k)
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(probe + start)), pa.array(stripes[stripe], pa.int32())], ["value", "stripe_id"])

    left = blocked.repartition(-(-max(1, blocked.count()) // BLOCKS), "m", "block")
    met = left.crossJoin(chunks.repartition(-(-n // CHUNKS), "part").drop("part"))
    return met.mapInArrow(hits, f"value {kind}, stripe_id int")


def sizes(filters: DataFrame) -> DataFrame:
    """One row: byte_size of all filters, and compressed_size of them, stripe by stripe."""

    def squeeze(group: pd.DataFrame) -> pd.DataFrame:
        m = int(group["m"].iloc[0])
        words = np.zeros(-(-m // 64), dtype="<i8")
        words[group["word"].to_numpy()] = group["bits"].to_numpy()
        raw = words.tobytes()[: -(-m // 8)]
        return pd.DataFrame({"raw": [len(raw)], "packed": [len(compress(raw))]})

    each = filters.groupBy("stripe_id").applyInPandas(squeeze, "raw long, packed long")
    return each.agg(F.sum("raw").alias("byte_size"), F.sum("packed").alias("compressed_size"))


def comparable_bits(striped: DataFrame, column: str, target: int, least: int = 1, most: int = 30) -> int:
    """The bits per key whose filters come closest to target compressed bytes (the fewer bits of
    two as close), by binary search: about five sizes."""
    return comparable_bits_from(kept(by_stripe(striped, column)), target, least, most)


def comparable_bits_from(stripes: DataFrame, target: int, least: int = 1, most: int = 30) -> int:
    """comparable_bits from the hashes of by_stripe, which are read for each size."""
    size: dict[int, int] = {}

    def off(bits: int) -> int:
        if bits not in size:
            size[bits] = sizes_from(stripes, bits).first()["compressed_size"] or 0
        return size[bits] - target

    lo, hi = least, most
    while lo < hi:
        mid = (lo + hi) // 2
        if off(mid) >= 0:
            hi = mid
        else:
            lo = mid + 1
    off(lo)
    off(max(least, lo - 1))
    return min(size, key=lambda b: (abs(size[b] - target), b))
