"""A data source over striped Parquet files that turns `column = value` into stripes to read."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


TASKS = 200  # that the stripes left are read by


class StripePartition(InputPartition):
    """Stripes that one task reads."""

    def __init__(self, stripes: list[int]) -> None:
        super().__init__(stripes)
        self.stripes = stripes


class StripedSource(DataSource):
    """Format `stripewise`. Options: path (as write_striped leaves it), zones (JSON: column ->
    stripe -> [min, max], a bounded summary of each stripe) and stripes (their number, the tail
    included). Needs spark.sql.python.filterPushdown.enabled, which filtered() sets.

    Spark keeps the filters pushed into a loaded frame with the frame, also for later queries
    on it, so a frame serves one filter: use filtered(), which loads anew each time."""

    @classmethod
    def name(cls) -> str:
        return "stripewise"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> "StripedReader":
        return StripedReader(schema, self.options)


class StripedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.names
        self.path = options["path"]
        self.left = list(range(int(options["stripes"])))
        self.zones = json.loads(options.get("zones", "{}"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Stripes whose zone holds none of the values are dropped; Spark checks rows again."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.zones:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                zones = self.zones[f.attribute[0]]
                self.left = [s for s in self.left if str(s) not in zones or self._may(zones[str(s)], values)]
            yield f

    @staticmethod
    def _may(zone: list | None, values: list) -> bool:
        return zone is not None and zone[0] is not None and any(v is not None and zone[0] <= v <= zone[1] for v in values)

    def partitions(self) -> list[StripePartition]:
        size = max(1, -(-len(self.left) // TASKS))
        return [StripePartition(self.left[i : i + size]) for i in range(0, len(self.left), size)]

    def read(self, partition: StripePartition):
        import pyarrow.dataset as ds
        from pyarrow import fs

        if partition is None:  # what Spark makes of no partitions at all
            return
        files, inner = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        table = ds.dataset(inner, filesystem=files, format="parquet", exclude_invalid_files=True)
        yield from table.to_batches(columns=self.names, filter=ds.field("stripe_id").isin(partition.stripes))


def filtered(spark: SparkSession, condition: Column, **options: str) -> DataFrame:
    """The rows of a striped table that meet a condition, from a frame of its own. Spark refuses a
    reader that takes filters in a session without filter pushdown, so it is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StripedSource)
    return spark.read.format(StripedSource.name()).options(**options).load().where(condition)


MOST_ZONES = 100_000


def zone_option(zones_by_column: dict) -> str:
    """The zones option from zone maps (column -> DataFrame of stripe_id, min, max): two values a
    stripe, for numbers and text, of MOST_ZONES stripes at most; pruned_scan takes more."""
    if any(z.count() > MOST_ZONES for z in zones_by_column.values()):
        raise ValueError(f"more than {MOST_ZONES} zones; use pruned_scan")
    return json.dumps({c: {str(r["stripe_id"]): [r["min"], r["max"]] for r in z.collect()} for c, z in zones_by_column.items()})
