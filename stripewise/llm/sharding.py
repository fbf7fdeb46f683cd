"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripewise.llm.common import cut

CELLS = 1 << 16  # of the ring
VNODES = 128  # points of a shard
PARTS = 8192  # that the rows of all arcs are ranked in, dealt to the arcs by their rows


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int]]:
    """The arcs (owner, first cell, last cell) in clockwise order.

    A point's place depends on its shard and number alone, so a further shard only adds
    points. At most shards * vnodes rows reach the driver, whatever the data.
    """
    points = (
        spark.range(shards * vnodes)
        .select(
            F.expr(f"cast(id div {vnodes} as int)").alias("shard"),
            F.shiftrightunsigned(F.xxhash64(F.lit("point"), F.expr(f"id div {vnodes}"), F.expr(f"id % {vnodes}")), 48)
            .cast("int")
            .alias("cell"),
        )
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
        .orderBy("cell")
        .collect()
    )
    arcs, first = [], 0
    for p in points:
        arcs.append((p["shard"], first, p["cell"]))
        first = p["cell"] + 1
    if first < CELLS:  # past the last point a key comes to the first one
        arcs.append((points[0]["shard"], first, CELLS - 1))
    return arcs


def fill(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot): where the keys of each arc go.

    Arcs are met clockwise; a shard takes an arc's own keys in rank order, then those carried
    along from full shards before it, each up to its capacity; what is left goes on clockwise.
    The capacities must add up to the number of keys or more; two laps then place all.
    """
    free, used = list(capacity), [0] * len(capacity)
    pieces: list[tuple[int, int, int, int, int]] = []
    carried: list[tuple[int, int, int]] = []
    for lap in range(2):
        for arc, shard in enumerate(owners):
            own = [(arc, 0, counts[arc])] if lap == 0 and counts[arc] else []
            left = []
            for a, lo, hi in own + carried:
                take = min(free[shard], hi - lo)
                if take:
                    pieces.append((a, lo, lo + take, shard, used[shard]))
                    free[shard] -= take
                    used[shard] += take
                if lo + take < hi:
                    left.append((a, lo + take, hi))
            carried = left
    if carried:
        raise ValueError("the capacities are below the number of keys")
    return pieces


def capacities(n: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows that each shard may hold: (1 + epsilon) times the mean; at 0, whole numbers that
    add up to n, so that all shards end full and their counts are at most one apart."""
    if epsilon > 0:
        return [-int(-(1 + epsilon) * n // shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    epsilon: float = 0.0,
    vnodes: int = VNODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's key is its id; it belongs to the arc of the ring that its hash falls into.
    Only the number of rows of each arc (a bounded table) comes to the driver, which sends the
    overflow of full shards clockwise as ranges of ranks; each row then finds its range by
    its rank within the arc. At epsilon 0 the law is `rows`: counts at most one apart; with
    slack no law of balance holds but the bound of capacities(), and it is named `bounded`.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32: of those bytes; slots are
    gapless from 0 in each shard; grown_shard is null, as it belongs to another law. Rows with
    a null or repeated id are keys like any other, told apart by text and place; an arc with a
    share of all rows is ranked in that share of PARTS parts. An empty table gives no rows; other columns of docs
    are not carried, so their names cannot clash.
    """
    spark = docs.sparkSession
    arcs = ring(spark, shards, vnodes)
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.xxhash64(F.lit("key"), F.col(id_col))
    cells = F.broadcast(  # CELLS rows, whatever the data
        spark.createDataFrame([(i, lo, hi) for i, (_, lo, hi) in enumerate(arcs)], "arc int, lo int, hi int").select(
            "arc", F.explode(F.sequence("lo", "hi")).alias("cell")
        )
    )
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        key.alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.shiftrightunsigned(key, 48).cast("int").alias("cell"),
    )
    placed = cut(rows.join(cells, "cell").drop("cell"))

    of_arc = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}
    per_arc = [of_arc.get(a, 0) for a in range(len(arcs))]
    parts = [1 + PARTS * n // max(1, sum(per_arc)) for n in per_arc]  # PARTS and an arc each at most
    dealt = F.broadcast(spark.createDataFrame(list(enumerate(parts)), "arc int, parts int"))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.col("parts")).cast("int")
    placed = placed.join(dealt, "arc").withColumn("part", part).drop("parts")
    counts = {(r["arc"], r["part"]): r["count"] for r in placed.groupBy("arc", "part").count().collect()}
    pieces = fill(per_arc, [a[0] for a in arcs], capacities(sum(per_arc), shards, epsilon))
    split = []  # the pieces, cut where the parts of an arc meet; ranks from 0 in each part
    starts = {}
    for a in range(len(arcs)):
        at = 0
        for p in range(parts[a]):
            starts[a, p] = at
            at += counts.get((a, p), 0)
    for a, lo, hi, shard, slot in pieces:
        for p in range(parts[a]):
            s, e = starts[a, p], starts[a, p] + counts.get((a, p), 0)
            x, y = max(lo, s), min(hi, e)
            if x < y:
                split.append((a, p, x - s, y - s, shard, slot + x - lo - (x - s)))
    to = F.broadcast(  # a few rows for each arc and part, whatever the data
        spark.createDataFrame(split, "arc int, part int, lo long, hi long, shard int, shift long")
    )
    rank = F.row_number().over(Window.partitionBy("arc", "part").orderBy("key", "doc_id", "row")) - 1
    return (
        placed.withColumn("rank", rank.cast("long"))
        .join(to, ["arc", "part"])
        .where("rank >= lo and rank < hi")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows" if epsilon == 0 else "bounded").alias("law"),
            "shard",
            (F.col("rank") + F.col("shift")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
