"""Zone map: the least and the largest value of each stripe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.functions.codecs import compress
from stripewise.operators import truth
from stripewise.session import kept, spread

NAME = "ZoneMap"
ENTRY_BYTES = 8
BINS, MOST_BINS = 64, 1 << 20
COVERED = 8  # bins that a zone covers on average, about
BLOCK = 65_536
#: Stripes that zones are sent to every task for: a few megabytes at most.
MOST_SENT = 100_000
#: Values that meet zones at a time, about.
TOGETHER = 64


def build(striped: DataFrame, column: str) -> DataFrame:
    """(stripe_id, min, max); null values are passed over, a stripe of nulls has null ends."""
    return striped.groupBy("stripe_id").agg(F.min(column).alias("min"), F.max(column).alias("max"))


def probe(zones: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (value, stripe_id) with maybe: whether the stripe may hold the value."""
    inside = F.coalesce(F.col("value").between(F.col("min"), F.col("max")), F.lit(False))
    return probes.join(zones, "stripe_id").select("value", "stripe_id", inside.alias("maybe"))


def probe_each(zones: DataFrame, values: DataFrame) -> DataFrame:
    """probe of every value (distinct) with every zone; the pairs are never shuffled. Some TOGETHER
    values meet truth.TILE zones before the next ones: near rows have few stripes, which a file of
    them keeps in a fraction of the bytes that rows by value take. The sort is of such meetings, a
    few hundred in a task; only behind it do they become rows."""
    zones, values = kept(zones), kept(values)
    n, parts = zones.count(), max(1, -(-values.count() // TOGETHER))
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part")
    # A list of structs keeps nulls, which are probed too.
    together = values.groupBy(part).agg(F.collect_list(F.struct("value")).alias("probes"))
    tile = F.expr(f"stripe_id div {truth.TILE}").alias("tile")
    tiles = zones.groupBy(tile).agg(F.sort_array(F.collect_list(F.struct("stripe_id", "min", "max"))).alias("zones"))
    met = spread(together, "part", n * TOGETHER, truth.MADE).crossJoin(F.broadcast(tiles) if n <= MOST_SENT else tiles)
    each = met.sortWithinPartitions("tile").select("zones", F.inline("probes")).select("value", F.inline("zones"))
    inside = F.coalesce(F.col("value").between(F.col("min"), F.col("max")), F.lit(False))
    return each.select("value", "stripe_id", inside.alias("maybe"))


def _number(c: Column, kind: str) -> Column:
    """A number that rises with the value: the value itself, days, microseconds, or the first six
    bytes of a text."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def candidates(zones: DataFrame, probes: DataFrame) -> DataFrame:
    """(value, stripe_id) of the stripes that may hold each probe (value).

    Up to MOST_SENT zones go to every task. Beyond, they meet by equal join: the range of all
    zones is cut into bins, the more of them the narrower the zones are, a zone is listed under
    each bin that it covers, and a probe looks at its own bin only."""
    values = probes.select("value").where(F.col("value").isNotNull()).distinct()
    if zones.count() <= MOST_SENT:
        return values.join(F.broadcast(zones), F.col("value").between(F.col("min"), F.col("max"))).select("value", "stripe_id")
    kind = dict(zones.dtypes)["min"]
    listed = zones.where(F.col("min").isNotNull()).withColumns({"lo": _number(F.col("min"), kind), "hi": _number(F.col("max"), kind)})
    least, largest, mean = listed.agg(F.min("lo"), F.max("hi"), F.avg(F.col("hi") - F.col("lo"))).first()
    if least is None:
        return listed.select(F.col("min").alias("value"), "stripe_id").limit(0)
    span = max(largest - least, 1e-300)
    bins = int(min(MOST_BINS, max(BINS, COVERED * span / max(mean, span / MOST_BINS))))
    bin_of = lambda x: F.floor((x - F.lit(least)) / F.lit(span) * F.lit(bins)).cast("int")
    listed = listed.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    met = values.withColumn("bin", bin_of(_number(F.col("value"), kind))).join(listed, "bin")
    return met.where(F.col("value").between(F.col("min"), F.col("max"))).select("value", "stripe_id")


def sizes(zones: DataFrame) -> tuple[int, int]:
    """Bytes of the zones, and of all minima and then all maxima of each BLOCK zones compressed
    and added up; the blocks are compressed where they lie."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("stripe_id")
        raw = "".join(f"{v}\n" for side in ("min", "max") for v in group[side])
        return pd.DataFrame({"zones": [len(group)], "packed": [len(compress(raw.encode()))]})

    block = F.expr(f"stripe_id div {BLOCK}").alias("block")
    rows = zones.select(block, "stripe_id", F.col("min").cast("string"), F.col("max").cast("string"))
    found = rows.groupBy("block").applyInPandas(packed, "zones long, packed long").agg(F.sum("zones"), F.sum("packed")).first()
    return ENTRY_BYTES * (found[0] or 0), found[1] or 0


def stats(zones: DataFrame, column_range: tuple) -> DataFrame:
    """One row: zones, those without values, and the mean share of the column's range (least,
    largest) that a zone covers; numbers only."""
    span = float(column_range[1]) - float(column_range[0]) or 1.0
    return zones.agg(
        F.count("*").alias("zones"),
        F.count_if(F.col("min").isNull()).alias("empty_zones"),
        F.avg((F.col("max") - F.col("min")) / F.lit(span)).alias("mean_width"),
    )
