"""Bitmap operators as relations: rows (bitmap_id, pos, bit), or the positions of the ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stripewise.functions import codecs
from stripewise.operators.stripes import with_row_id
from stripewise.session import spread


BLOCK = 65_536
CODECS = [
    "bitpacked_compressed_size", "rle_size", "rle_compressed_size", "roaring_size", "roaring_compressed_size",
    "roaring_individual_size", "roaring_individual_compressed_size",
]


def _by_pos():
    return Window.partitionBy("bitmap_id").orderBy("pos")


def from_bits(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(bitmap_id, pos, bit) from an array of zeros and ones."""
    return df.select("bitmap_id", F.posexplode(bits).alias("pos", "bit"))


def from_stripes(values: DataFrame, num_stripes: int) -> DataFrame:
    """(bitmap_id, pos, bit) of the stripe sets (bitmap_id, stripes), run by run of zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    last = lambda i: F.coalesce(F.get("stripes", i - 1), F.lit(-1))
    runs = F.flatten(F.transform("stripes", lambda p, i: F.concat(zeros(p - last(i) - 1), F.array(F.lit(1)))))
    bits = F.concat(runs, zeros(F.lit(num_stripes) - F.size(runs)))
    return values.select("bitmap_id", F.posexplode(bits).alias("pos", "bit"))


def ones(sets: DataFrame) -> DataFrame:
    """(bitmap_id, ith, pos, gap) of every one of the stripe sets (bitmap_id, stripes): how many
    ones lie before it, and the zeros and the one since the last. Rows are the ones, not the bits."""
    last = lambda i: F.coalesce(F.get("stripes", i - 1), F.lit(-1))
    each = F.transform(
        "stripes", lambda p, i: F.struct(i.cast("long").alias("ith"), p.alias("pos"), (p - last(i)).cast("long").alias("gap"))
    )
    return sets.select("bitmap_id", F.inline(each))


def _closed(sets: DataFrame, num_stripes: int) -> DataFrame:
    """ones of the sets with a one thought of behind each end."""
    return ones(sets.select("bitmap_id", F.concat("stripes", F.array(F.lit(num_stripes))).alias("stripes")))


def rank_steps(sets: DataFrame, num_stripes: int) -> DataFrame:
    """(bitmap_id, pos, length, rank): positions pos to pos + length - 1 have rank ones before
    them. The steps cover each of the num_stripes positions once."""
    length = F.col("gap") - (F.col("pos") == num_stripes).cast("int")
    return _closed(sets, num_stripes).select(
        "bitmap_id", (F.col("pos") - F.col("gap") + 1).alias("pos"), length.alias("length"), F.col("ith").alias("rank")
    ).where("length > 0")


def zero_runs(sets: DataFrame, num_stripes: int) -> DataFrame:
    """(bitmap_id, ith, pos, length): zeros number ith to ith + length - 1 are at pos and on."""
    start = F.col("pos") - F.col("gap") + 1
    return _closed(sets, num_stripes).where("gap > 1").select(
        "bitmap_id", (start - F.col("ith")).alias("ith"), start.alias("pos"), (F.col("gap") - 1).alias("length")
    )


def _starts_run(p, i):
    return F.coalesce(F.get("stripes", i - 1) < p - 1, F.lit(True))


def set_measures(sets: DataFrame, num_stripes: int) -> DataFrame:
    """measures of the stripe sets, without their zeros."""
    n = F.size("stripes")
    runs = F.size(F.filter("stripes", _starts_run))
    return sets.select(
        "bitmap_id",
        F.lit(num_stripes).cast("long").alias("bits"),
        n.cast("long").alias("ones"),
        (n / F.lit(num_stripes)).alias("density"),
        F.when(n > 0, n / runs).otherwise(0.0).alias("clustering"),
    )


def set_concatenated(sets: DataFrame, num_stripes: int) -> DataFrame:
    """(bitmap_id, pos, global_pos) of the ones of the bitmaps back to back, by bitmap_id. The
    bitmaps' numbers come from each partition's count."""
    numbered = with_row_id(sets, "bitmap_id", name="nth")
    return numbered.select("bitmap_id", "nth", F.explode("stripes").alias("pos")).select(
        "bitmap_id", "pos", (F.col("nth") * num_stripes + F.col("pos")).alias("global_pos")
    )


def set_extract(sets: DataFrame, num_stripes: int, offset: int, size: int) -> DataFrame:
    """extract of the stripe sets: the bits of the slice alone are made."""
    inside = range(offset, min(offset + size, num_stripes))
    slots = F.array(*[F.lit(p) for p in inside]).cast("array<int>")
    return sets.select("bitmap_id", "stripes", F.explode(slots).alias("p")).select(
        "bitmap_id", (F.col("p") - offset).alias("pos"), F.array_contains("stripes", F.col("p")).cast("int").alias("bit")
    )


def set_roaring_size(sets: DataFrame) -> DataFrame:
    """roaring_size of the stripe sets."""
    each = F.transform(
        "stripes", lambda p, i: F.struct(F.floor(p / 65536).alias("chunk"), (_starts_run(p, i) | (p % 65536 == 0)).cast("int").alias("starts"))
    )
    chunks = sets.select("bitmap_id", F.inline(each)).groupBy("bitmap_id", "chunk").agg(
        F.count("*").alias("n"), F.sum("starts").alias("runs")
    )
    least = F.least(2 * F.col("n"), F.lit(8192), 2 + 4 * F.col("runs"))
    return chunks.groupBy("bitmap_id").agg(F.sum(least).alias("roaring_bytes"))


def rank(bits: DataFrame) -> DataFrame:
    """bits with rank: the ones before each position."""
    before = _by_pos().rowsBetween(Window.unboundedPreceding, -1)
    return bits.withColumn("rank", F.coalesce(F.sum("bit").over(before), F.lit(0)).cast("long"))


def select(bits: DataFrame, bit: int) -> DataFrame:
    """(bitmap_id, ith, pos): where the ith one (or zero) is, counted from 0."""
    ith = (F.row_number().over(_by_pos()) - 1).cast("long")
    return bits.where(F.col("bit") == bit).select("bitmap_id", ith.alias("ith"), "pos")


def measures(bits: DataFrame) -> DataFrame:
    """Per bitmap: bits, ones, density, and clustering, the mean length of its runs of ones."""
    island = F.col("pos") - F.row_number().over(_by_pos())
    runs = (
        bits.where("bit = 1")
        .withColumn("island", island)
        .groupBy("bitmap_id")
        .agg((F.count("*") / F.count_distinct("island")).alias("clustering"))
    )
    size = bits.groupBy("bitmap_id").agg(
        F.count("*").alias("bits"), F.sum("bit").cast("long").alias("ones"), F.avg("bit").alias("density")
    )
    return size.join(runs, "bitmap_id", "left").withColumn("clustering", F.coalesce("clustering", F.lit(0.0)))


def _offsets(sizes: DataFrame) -> DataFrame:
    """(bitmap_id, offset): sums of size over the bitmaps before, by bitmap_id. Bitmaps are numbered
    and summed up in blocks of BLOCK; the driver sums up one number for each block."""
    numbered = with_row_id(sizes, "bitmap_id", name="nth").withColumn("block", F.expr(f"nth div {BLOCK}"))
    starts, at = [], 0
    for r in sorted(numbered.groupBy("block").agg(F.sum("size").alias("n")).collect()):
        starts.append((r["block"], at))
        at += r["n"]
    before = sizes.sparkSession.createDataFrame(starts, "block long, before long")
    within = F.sum("size").over(Window.partitionBy("block").orderBy("nth")) - F.col("size")
    return numbered.withColumn("within", within).join(before, "block").select("bitmap_id", (F.col("before") + F.col("within")).cast("long").alias("offset"))


def concatenated(bits: DataFrame) -> DataFrame:
    """(bitmap_id, pos, global_pos, bit): the bitmaps back to back, by bitmap_id."""
    offsets = _offsets(bits.groupBy("bitmap_id").agg((F.max("pos") + 1).cast("long").alias("size")))
    return bits.join(offsets, "bitmap_id").select("bitmap_id", "pos", (F.col("pos") + F.col("offset")).alias("global_pos"), "bit")


def gaps(bits: DataFrame) -> DataFrame:
    """(bitmap_id, pos, gap): the zeros and the one from the last one to each."""
    last = F.lag("pos", 1, -1).over(_by_pos())
    return bits.where("bit = 1").select("bitmap_id", "pos", (F.col("pos") - last).cast("long").alias("gap"))


def extract(bits: DataFrame, offset: int, size: int) -> DataFrame:
    """The slice of every bitmap, its positions from 0."""
    inside = bits.where(F.col("pos").between(offset, offset + size - 1))
    return inside.select("bitmap_id", (F.col("pos") - offset).alias("pos"), "bit")


def bitpacked_size(num_bitmaps: int, num_stripes: int) -> int:
    """Bytes of that many bitmaps of one bit per stripe, back to back."""
    return -(-num_bitmaps * num_stripes // 8)


def roaring_size(bits: DataFrame) -> DataFrame:
    """(bitmap_id, roaring_bytes): per chunk of 2**16 positions the least of an array (two
    bytes a one), a bitmap (8192) and runs (2 + 4 a run)."""
    ones = bits.where("bit = 1").withColumn("chunk", F.expr("pos div 65536"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("bitmap_id", "chunk").orderBy("pos"))
    chunks = ones.withColumn("island", island).groupBy("bitmap_id", "chunk").agg(
        F.count("*").alias("n"), F.count_distinct("island").alias("runs")
    )
    least = F.least(2 * F.col("n"), F.lit(8192), 2 + 4 * F.col("runs"))
    return chunks.groupBy("bitmap_id").agg(F.sum(least).alias("roaring_bytes"))


def packed(bits: DataFrame) -> DataFrame:
    """(bitmap_id, payload): each bitmap as bytes, a bit count and then the bits, for keeping
    in a table. A task holds one bitmap at a time."""
    kind = bits.schema["bitmap_id"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        payload = codecs.dense_encode(group.sort_values("pos")["bit"].to_numpy())
        return pd.DataFrame({"bitmap_id": group["bitmap_id"].iloc[:1], "payload": [payload]})

    return bits.groupBy("bitmap_id").applyInPandas(pack, f"bitmap_id {kind}, payload binary")


#: Bitmaps that one task packs, about.
PACKED = 20_000


def packed_sets(sets: DataFrame, num_stripes: int) -> DataFrame:
    """(bitmap_id, payload): the bitmaps of the stripe sets (bitmap_id, stripes) as run-length
    bitmaps, made from the ones alone; bits never become rows."""

    @F.pandas_udf(T.BinaryType())
    def pack(stripes: pd.Series) -> pd.Series:
        return stripes.map(lambda s: codecs.RleBitmap.from_ones(s, num_stripes).encode())

    return spread(sets, "bitmap_id", 1, PACKED).select("bitmap_id", pack("stripes").alias("payload"))


def unpacked_ones(stored: DataFrame) -> DataFrame:
    """(bitmap_id, pos) of the ones of packed_sets."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: codecs.RleBitmap.decode(p).ones().astype(np.int32))

    return stored.select("bitmap_id", F.explode(unpack("payload")).alias("pos"))


def unpacked(stored: DataFrame) -> DataFrame:
    """(bitmap_id, pos, bit) of packed bitmaps."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: codecs.dense_decode(p).astype("int32"))

    return from_bits(stored.select("bitmap_id", unpack("payload").alias("bits")))


def global_measures(sets: DataFrame, num_stripes: int) -> DataFrame:
    """One row: bitmaps, and density and clustering (mean length of the runs of ones) of the
    stripe sets (bitmap_id, stripes) laid end to end by bitmap_id. A run over the border of two
    bitmaps counts once."""
    numbered = with_row_id(sets, "bitmap_id", name="nth").select(
        "nth",
        F.size("stripes").alias("ones"),
        F.size(F.filter("stripes", _starts_run)).alias("runs"),
        (F.get("stripes", F.lit(0)) == 0).alias("begins"),
        (F.element_at("stripes", -1) == num_stripes - 1).alias("ends"),
    )
    next_one = numbered.where("begins").select((F.col("nth") - 1).alias("nth"), F.lit(1).alias("joined"))
    met = numbered.join(next_one, "nth", "left").agg(
        F.count("*").alias("bitmaps"),
        F.coalesce(F.sum("ones"), F.lit(0)).alias("ones"),
        F.coalesce(F.sum("runs") - F.sum(F.when(F.col("ends"), F.coalesce("joined", F.lit(0))).otherwise(0)), F.lit(0)).alias("runs"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return met.select(
        "bitmaps", ratio(F.col("ones"), F.col("bitmaps") * num_stripes).alias("density"), ratio(F.col("ones"), F.col("runs")).alias("clustering")
    )


#: Bits that one task lays end to end at most, bitmaps longer than that being tasks of their own.
PART_BITS = 1 << 26


def codec_sizes(values: DataFrame, num_stripes: int) -> DataFrame:
    """One row of bytes of the stripe sets (bitmap_id, stripes) laid end to end by bitmap_id, in
    parts of up to PART_BITS bits that are added up: bits packed and compressed, run lengths and
    Roaring containers raw and compressed, and Roaring containers of each bitmap alone, compressed.

    All are made from the places of the ones; only the packed bits take a byte for eight bits."""

    def size(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        stripes = [np.asarray(s, np.int64) for s in group["stripes"]]
        ones = np.concatenate([s + i * num_stripes for i, s in enumerate(stripes)])
        bits = len(group) * num_stripes
        plain = np.zeros(-(-bits // 8), np.uint8)
        np.bitwise_or.at(plain, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        rle = codecs.RleBitmap.from_ones(ones, bits).encode()
        roaring = codecs.roaring_containers(ones)
        alone = [codecs.roaring_containers(s) for s in stripes]
        sizes = [plain.tobytes(), rle, roaring]
        return pd.DataFrame(
            [[len(codecs.compress(sizes[0])), len(rle), len(codecs.compress(rle)), len(roaring), len(codecs.compress(roaring))]
             + [sum(len(a) for a in alone), sum(len(codecs.compress(a)) for a in alone)]], columns=CODECS
        )

    part = F.expr(f"nth div {max(1, PART_BITS // max(1, num_stripes))}").alias("part")
    numbered = with_row_id(values, "bitmap_id", name="nth").select(part, "nth", "stripes")
    each = numbered.groupBy("part").applyInPandas(size, ", ".join(f"{c} long" for c in CODECS))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CODECS])
