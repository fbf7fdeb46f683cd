"""Packing: token streams are concatenated and cut at fixed windows by two-pass prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.llm.common import stored
from stripewise.llm.tokens import text_ids

WINDOW = 1024
ID_BYTES = 4
BATCH_BYTES = 4 << 20


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (bytes of little-endian unsigned 32-bit ids, end_id last), n, and where
    the row's ids begin within its task: part, start."""
    id_type = docs.schema[id_col].dataType
    end = int(end_id).to_bytes(ID_BYTES, "little")
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = text_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, starts, sizes, out, held = 0, [], [], [], 0
            for i in range(batch.num_rows):
                ids = tok.ids(texts[i].as_py() or "") + end
                n = len(ids) // ID_BYTES
                starts.append(at)
                sizes.append(n)
                out.append(ids)
                at, held = at + n, held + len(ids)
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    k = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(first, k),
                            pa.array([part] * k, pa.int32()),
                            pa.array(starts, pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array(out, pa.binary()),
                        ],
                        names=schema.names,
                    )
                    first, starts, sizes, out, held = i + 1, [], [], [], 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, schema
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    The texts' ids, each text's followed by end_id, form one stream in scan order. The first
    pass tokenises, stores the ids and leaves a token total per task; the totals, one number
    per task, are summed up into global offsets. The second pass cuts each text where windows
    end: a text across a boundary gives a piece on either side, and pieces of one text and
    sequence are found by sequence_id and offset. All sequences but the last are full.

    Null texts count as empty and give one piece, the end id. Repeated rows and null ids are
    packed like any other row; an empty table gives no rows; other columns are not carried,
    so their names cannot clash.
    """
    spark = docs.sparkSession
    toks = stored(tokenized(docs, tokenizer, end_id, id_col, text_col), "ids")
    totals = toks.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("n")).collect()  # one per task
    at, offsets = 0, []
    for r in sorted(totals):
        offsets.append((r["part"], at))
        at += r["n"]
    before = spark.createDataFrame(offsets, "part int, base long")
    if len(offsets) <= 1_000_000:
        before = F.broadcast(before)
    lo = F.col("base") + F.col("start")
    hi = lo + F.col("n")

    def piece(seq):
        a = F.greatest(lo, seq * window)
        b = F.least(hi, (seq + 1) * window)
        return F.struct(
            (a - lo).alias("start"),
            (b - a).alias("length"),
            F.substring(F.col("ids"), ((a - lo) * ID_BYTES + 1).cast("int"), ((b - a) * ID_BYTES).cast("int")).alias("ids"),
            seq.alias("sequence_id"),
            (a - seq * window).alias("offset"),
        )

    seqs = F.sequence(F.expr(f"(base + start) div {window}"), F.expr(f"(base + start + n - 1) div {window}"))
    return (
        toks.join(before, "part")
        .select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(seqs, piece)).alias("p"))
        .select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
    )


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (bytes, padded to window), length, and
    boundaries (doc_id, start, offset, length of each piece). A group is one window at most."""
    p = F.struct("offset", "length", "doc_id", "start", "ids")
    pad = int(pad_id).to_bytes(ID_BYTES, "little")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(p)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    length = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return rows.select(
        "sequence_id",
        F.rpad(joined, F.lit(window * ID_BYTES), F.lit(pad)).alias("ids"),
        length.alias("length"),
        F.transform("p", lambda x: x.dropFields("ids")).alias("boundaries"),
    )
