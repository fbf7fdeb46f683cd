"""Hashes and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_SEEDS = (17, 23)
FINGERPRINT_SEED = 42
SHARD_SEED = 7


def hash64(seed: int, value: Column) -> Column:
    """A seeded 64-bit hash; integers of any width give the same as BIGINT."""
    return F.xxhash64(F.lit(seed).cast("long"), value)


def md5_hash(seed: int, value: Column) -> Column:
    """60 bits of an MD5, which other engines compute alike; slower than hash64."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), value.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def suffix(fp: Column, bits: Column) -> Column:
    """The lowest bits of a fingerprint: none for 0, all for 64 or more."""
    mask = F.when(bits >= 64, F.lit(-1).cast("long")).otherwise(
        F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bits.cast("int")))
    )
    return fp.bitwiseAND(mask)


def prefix(fp: Column, bits: Column) -> Column:
    """The highest bits of a fingerprint, moved to the low end."""
    moved = F.call_function("shiftrightunsigned", fp, (F.lit(64) - bits).cast("int"))
    return F.when(bits == 0, F.lit(0).cast("long")).when(bits >= 64, fp).otherwise(moved)


def fingerprint_bits(fp: Column, bits: Column, use_prefix: Column) -> Column:
    return F.when(use_prefix, prefix(fp, bits)).otherwise(suffix(fp, bits))


def collision_free_bits(fps: Column, use_prefix: bool = False) -> Column:
    """The least n from 1 to 64 at which the array's fingerprints differ; 0 for fewer than two."""
    cut = prefix if use_prefix else suffix
    differ = lambda n: F.size(F.array_distinct(F.transform(fps, lambda f: cut(f, n)))) == F.size(fps)
    return F.when(F.size(fps) < 2, F.lit(0)).otherwise(
        F.get(F.filter(F.sequence(F.lit(1), F.lit(64)), differ), F.lit(0))
    )


def scan_rate_bits(least: Column, density: Column, mean_ones: Column, scan_rate: float) -> Column:
    """The least n from `least` on with 2 * density * mean_ones / 2**n <= scan_rate."""
    need = F.ceil(F.log2(2 * density * mean_ones / F.lit(scan_rate)))
    return F.greatest(least, F.coalesce(need, F.lit(0))).cast("int")
