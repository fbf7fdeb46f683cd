"""Mixing sources to target weights: blocks of words drawn by multinomial counts per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stripewise.llm.common import cut, steady

BLOCK_WORDS = 64
SHARDS = 64
MAX_EPOCHS = 3
RUN = 4096  # slots made from one row
WORD = r"[^\x20\x09-\x0D]+"
UNIT = WORD + r"[\x20\x09-\x0D]*"


def water_fill(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess of those
    being shared by weight among the others until none is above."""
    targets = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in sorted(over):
            targets[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        open_ -= over
    return targets


def draw_counts(wanted: list[float], room: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each output shard: multinomial draws whose probabilities follow
    what a source still lacks, so that the totals end near wanted; none goes beyond its room
    (blocks times epochs): what is drawn beyond is drawn again among the others."""
    rng = np.random.default_rng(seed)
    total = round(sum(wanted))
    out = np.zeros((shards, len(wanted)), dtype=np.int64)
    used = np.zeros(len(wanted), dtype=np.int64)
    want, most = np.array(wanted), np.array(room, dtype=np.int64)
    for k in range(shards):
        m = total * (k + 1) // shards - total * k // shards
        while m > 0:
            free = most - used
            lacking = np.where(free > 0, np.maximum(want - used, 0), 0)
            if lacking.sum() <= 0:
                lacking = np.where(free > 0, want, 0)
            if lacking.sum() <= 0:
                break
            got = np.minimum(rng.multinomial(m, lacking / lacking.sum()), free)
            out[k] += got
            used += got
            m -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(n), chosen by key, puts index: a four-round
    Feistel network over the next even power of two, walked on until inside the range."""
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (int(v - 1).bit_length() + 1) // 2) for v in np.unique(n).tolist()], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, mk, ky = half[todo], mask[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & mk
            for r in range(4):
                f = (right + ky * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0x94D049BB133111EB)
                f ^= f >> np.uint64(32)
                left, right = right, left ^ (f & mk)
            x[todo] = (left << h) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _slots_and_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, key, slot, block, both permuted in the same worker: places in the shard and draws
    of the source come with their ranges and keys."""
    for batch in batches:
        of = {name: column.to_numpy() for name, column in zip(batch.schema.names[2:], batch.columns[2:], strict=True)}
        slot = permuted(of["place"], of["shard_n"], of["slot_key"])
        block = permuted(of["draw"], of["blocks"], of["block_key"])
        yield pa.RecordBatch.from_arrays([batch["shard"], batch["key"], pa.array(slot), pa.array(block)], names=["shard", "key", "slot", "block"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows with at: the words of the same source in the rows before them. Rows stay
    where they were read, and a task keeps one number for each of its sources."""
    seen: dict[str, int] = {}
    for batch in batches:
        at = []
        for key, size in zip(batch["key"].to_pylist(), batch["size"].to_pylist(), strict=True):
            at.append(seen.get(key, 0))
            seen[key] = at[-1] + size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


@dataclass
class Mix:
    """docs: the table mixed, its rows numbered by their place.
    documents: doc_id, row, source, size (words), source_size, target.
    pieces: shard, slot, source, block, doc_id, row, start, length: the mix, in words of the
    documents; slots count the blocks of an output shard, in mixed order."""

    docs: DataFrame
    documents: DataFrame
    pieces: DataFrame


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Mixes the words of docs so that each source's share nears its target.

    Sources take the weights in turn, by code point, null last. Each source's texts are one
    stream of words in scan order, cut into blocks of block_words (the last may be shorter);
    running sums per task and source, then over the tasks, place a text in its stream. The
    driver sees one row per source (their number must be modest) and draws how many blocks of
    each source go to each output shard. The j-th block drawn from a source of n blocks is
    block p(j mod n), p being a pseudorandom permutation of its own for every pass over the
    source, and joins the pieces of texts by (source, block). A source is passed over three
    times at most, so no text is taken more often. The seed alone decides: reruns agree.

    Null and empty texts have no words, and are in documents with nothing taken; a null source
    is a source of its own; repeated rows and null ids are told apart by their place; an empty
    table gives no rows; other columns are not carried, so their names cannot clash.
    """
    spark, docs = docs.sparkSession, steady(docs)
    # A source's key: null apart from any string.
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("key"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("part", F.shiftright("row", 33))
    schema = T.StructType([*sized.schema, T.StructField("at", T.LongType())])
    sized = cut(sized.mapInArrow(_running, schema))
    found = sized.groupBy("key").agg(F.sum("size").alias("size")).collect()  # one per source
    found = sorted(found, key=lambda r: (r["key"] == "-", r["key"]))
    sizes = [r["size"] for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))])
    blocks = [-(-n // block_words) for n in sizes]
    wanted = [t * b / n if n else 0.0 for t, b, n in zip(targets, blocks, sizes, strict=True)]
    drawn = draw_counts(wanted, [MAX_EPOCHS * b for b in blocks], shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn  # of a shard among the draws of a source
    place = np.cumsum(drawn, axis=1) - drawn  # of a source among the slots of a shard
    plan = [
        (k, found[s]["key"], int(first[k, s]), int(place[k, s]), int(drawn[k, s]), blocks[s], s, int(drawn[k].sum()))
        for k in range(shards)
        for s in range(len(found))
        if drawn[k, s]
    ]
    sources = spark.createDataFrame(
        [(r["key"], n, t) for r, n, t in zip(found, sizes, targets, strict=True)], "key string, source_size long, target double"
    )
    if len(found) <= 100_000:
        sources = F.broadcast(sources)

    runs = spark.createDataFrame(
        plan, "shard int, key string, first long, place long, n long, blocks long, source_no int, shard_n long"
    )
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    each = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))
    draw = F.col("first") + F.col("i")
    slots = (
        runs.repartition("shard", "key", "run")
        .withColumn("i", each)
        .select(
            "shard",
            "key",
            (F.col("place") + F.col("i")).alias("place"),
            "shard_n",
            F.xxhash64(F.lit(seed), "shard").alias("slot_key"),
            (draw % F.col("blocks")).alias("draw"),
            "blocks",
            F.xxhash64(F.lit(seed + 1), "source_no", F.expr("(first + i) div blocks")).alias("block_key"),
        )
        .mapInArrow(_slots_and_blocks, "shard int, key string, slot long, block long")
    )

    sums = sized.groupBy("key", "part").agg(F.sum("size").alias("n"))
    before = sums.select(
        "key", "part", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("before")
    )
    placed = sized.join(before, ["key", "part"]).withColumn("at", F.col("at") + F.col("before"))

    def piece(b):
        lo = F.greatest(F.col("at"), b * block_words)
        hi = F.least(F.col("at") + F.col("size"), (b + 1) * block_words)
        return F.struct(b.alias("block"), (lo - F.col("at")).alias("start"), (hi - lo).alias("length"))

    cuts = F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))
    parts = (
        placed.where("size > 0")
        .select("key", "source", "doc_id", "row", F.explode(F.transform(cuts, piece)).alias("p"))
        .select("key", "source", "doc_id", "row", "p.block", "p.start", "p.length")
    )
    # The planner takes the slots for as few as the rows that they are made from: no broadcast.
    mixed = slots.hint("merge").join(parts, ["key", "block"]).select(
        "shard", "slot", "source", "block", "doc_id", "row", "start", "length"
    )
    return Mix(docs, sized.join(sources, "key").select("doc_id", "row", "source", "size", "source_size", "target"), mixed)


def taken_words(mix: Mix) -> DataFrame:
    """documents of the mix with taken: the words that it takes, repeats counted."""
    taken = mix.pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return mix.documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(mix: Mix, text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them, with all their columns: a row for each time that
    some of a text is taken, holding the words taken that often, in order and with the spaces
    behind them."""
    docs = mix.docs
    times = mix.pieces.groupBy("row", "start", "length").count()
    took = times.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "count"))).alias("__took"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id()).join(took.withColumnRenamed("row", "__row"), "__row")
    units = F.regexp_extract_all(F.col(text_col), F.lit(UNIT), F.lit(0))
    copies = F.sequence(F.lit(1), F.array_max(F.transform("__took", lambda p: p["count"])).cast("int"))
    taken = F.transform(
        F.filter("__took", lambda p: p["count"] >= F.col("__copy")),
        lambda p: F.slice(F.col("__units"), p["start"].cast("int") + 1, p["length"].cast("int")),
    )
    text = F.array_join(F.flatten(taken), "")
    return (
        rows.withColumn("__units", units)
        .withColumn("__copy", F.explode(copies))
        .withColumn(text_col, text)
        .select(*docs.columns)
    )
