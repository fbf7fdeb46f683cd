"""Stripes that arrive over time: zone maps and filters of new stripes are appended.

Only per-stripe indexes can grow so; the hash index needs all values when it is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stripewise.operators import bloom, zonemap


def append_indexes(stream: DataFrame, column: str, path: str, checkpoint: str, bits_per_key: int = 10) -> StreamingQuery:
    """Writes zones and Bloom filters of each batch of complete stripes under path.

    stream: rows with stripe_id, all rows of a stripe in one batch. A batch that is written
    again replaces itself, as it has a folder of its own, so a stripe is listed once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        zonemap.build(batch, column).write.mode("overwrite").parquet(f"{path}/zones/batch={number}")
        bloom.build(batch, column, bits_per_key).write.mode("overwrite").parquet(f"{path}/bloom/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per time window and key, late rows counted up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
