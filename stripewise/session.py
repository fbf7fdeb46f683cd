"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "stripewise", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, filter pushdown into Python data sources, and
    checkpoints that go when nothing refers to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only on one machine,
    where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = "file:///tmp/checkpoints/stripewise"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Makes the folder where it is not there yet (only what exists can be marked) and has it
    deleted when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def spread(df: DataFrame, key: str, made: int, most: int) -> DataFrame:
    """df, computed once, in tasks by key so that each makes about `most` rows where every row
    becomes `made`; adaptive execution would put a small df into one task."""
    df = kept(df)
    tasks = -(-df.count() * made // most)
    return df.repartition(max(1, tasks, df.sparkSession.sparkContext.defaultParallelism), key)


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
