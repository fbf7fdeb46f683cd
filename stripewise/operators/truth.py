"""The exact answer: which stripes hold a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripewise.session import spread

#: Rows of a product of values and stripes that one task makes, about.
MADE = 1 << 25
#: Stripes (or values) that follow each other in a product before the next value (or stripe).
TILE = 256


def pairs(striped: DataFrame, column: str) -> DataFrame:
    """Distinct (value, stripe_id), without null: `column = null` is true of no row."""
    return striped.select(F.col(column).alias("value"), "stripe_id").where(F.col("value").isNotNull()).distinct()


def value_stripes(striped: DataFrame, column: str) -> DataFrame:
    """(value, stripes): the inverted index, stripes in order; reduced before the shuffle."""
    return pairs(striped, column).groupBy("value").agg(F.sort_array(F.collect_list("stripe_id")).alias("stripes"))


def stripe_contains(striped: DataFrame, column: str, probes: DataFrame) -> DataFrame:
    """probes (value, stripe_id) with found."""
    true = pairs(striped, column).withColumn("found", F.lit(True))
    return probes.join(true, ["value", "stripe_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contains_each(striped: DataFrame, column: str, num_stripes: int) -> DataFrame:
    """(value, stripe_id, found): every value of the stripes with every stripe. Only the values'
    stripe sets are shuffled; the rows of the product are made from them and go on at once, TILE
    stripes of all values of a task before the next ones: near rows have few stripes, which a file
    of them keeps in a fraction of the bytes that rows by value take."""
    sets = spread(value_stripes(striped, column), "value", num_stripes, MADE)
    tiles = sets.select("value", "stripes", F.explode(F.sequence(F.lit(0), F.lit(max(0, num_stripes - 1)), F.lit(TILE))).alias("tile"))
    end = F.least(F.col("tile") + TILE, F.lit(num_stripes)) - 1
    held = F.filter("stripes", lambda s: s.between(F.col("tile"), end)).alias("held")
    stripe = F.explode(F.sequence("tile", end)).alias("stripe_id")
    each = tiles.select("value", "tile", held).sortWithinPartitions("tile").select("value", "held", stripe)
    return each.select("value", "stripe_id", F.array_contains("held", F.col("stripe_id")).alias("found"))


def qualifying(found: DataFrame, probes: DataFrame) -> DataFrame:
    """(value, stripes) of pairs found; probes (value) that no stripe answers keep an empty set."""
    sets = found.groupBy("value").agg(F.sort_array(F.collect_set("stripe_id")).alias("stripes"))
    return probes.select("value").distinct().join(sets, "value", "left").withColumn(
        "stripes", F.coalesce("stripes", F.array().cast("array<int>"))
    )
