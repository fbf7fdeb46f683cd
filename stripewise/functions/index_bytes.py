"""Bytes of the hash index as it would be laid out: fingerprints by length, and stripe bitmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stripewise.functions.codecs import RleBitmap, bit_pack, compress, varint

PART = 4096  # buckets that one task encodes at a time


def encoded_size(index) -> tuple[int, int]:
    """Raw and compressed bytes, added up over parts of PART buckets each: a bitmap of empty
    buckets; for each length of fingerprints the buckets that have it and the fingerprints packed;
    where prefixes may be stored the buckets that do; and the stripe bitmaps end to end."""
    stripes, prefixes = index.num_stripes, index.config.prefix_bits

    def size(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bucket", "slot"])
        at = group["bucket"].to_numpy() % PART
        of = lambda places: RleBitmap.from_ones(np.unique(places), PART).encode()
        out = [of(at)]
        if prefixes:
            out.append(of(at[group["use_prefix"].to_numpy(bool)]))
        for bits, same in group.groupby("num_bits"):
            out.append(varint(int(bits)) + varint(len(same)) + of(same["bucket"].to_numpy() % PART))
            if bits < 64:
                out.append(bit_pack(same["fp"].to_numpy().view(np.uint64), int(bits)))
            else:
                out.append(same["fp"].to_numpy().tobytes())
        ones = [np.asarray(s, np.int64) + i * stripes for i, s in enumerate(group["stripes"])]
        out.append(RleBitmap.from_ones(np.concatenate(ones), len(group) * stripes).encode())
        raw = b"".join(out)
        return pd.DataFrame({"raw": [len(raw)], "packed": [len(compress(raw))]})

    parts = index.slots.groupBy("shard", F.expr(f"bucket div {PART}").alias("part")).applyInPandas(size, "raw long, packed long")
    total = parts.agg(F.sum("raw"), F.sum("packed")).first()
    return total[0] or 0, total[1] or 0
