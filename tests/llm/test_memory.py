"""The pipeline on check_h took more than its executors have: files of small tables, batches, workers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stripewise.llm import common
from stripewise.llm.components import components
from stripewise.llm.minhash import near_duplicates, signatures
from stripewise.llm.mixing import mix_sources
from stripewise.llm.quality_crf import score_quality, train

PARTS = 53


@pytest.fixture
def kept_parts(spark, monkeypatch):
    """Partitions of all that is kept, where shuffles have PARTS and adaptive execution joins none."""
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in held}
    made, kept = [], common.kept

    def counted(df):
        out = kept(df)
        made.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "kept", counted)
    for k, v in held.items():
        spark.conf.set(k, v)
    yield made
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rounds_of_components_are_few_files(spark, kept_parts):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, i - i % 10) for i in range(40)}
    assert len(kept_parts) > 4 and max(kept_parts[1:]) <= spark.sparkContext.defaultParallelism


def test_near_duplicates_keeps_few_files(spark, kept_parts, docs_of):
    texts = [" ".join(f"w{g}x{j}" for j in range(60)) + f" end{i % 4}" for g in range(6) for i in range(8)]
    got = near_duplicates(docs_of([(i, t, "a") for i, t in enumerate(texts)]), 5, 80).select("doc_id", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == [(i, i - i % 8) for i in range(48)]
    few = sum(n <= spark.sparkContext.defaultParallelism for n in kept_parts)
    assert len(kept_parts) > 12 and few >= len(kept_parts) - 4  # not those whose rows nobody knows


def test_no_more_tasks_are_joined_than_rows_allow(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 1000, 1, 10 * cores)
    assert common.cut(df).rdd.getNumPartitions() == 10 * cores
    monkeypatch.setattr(common, "ROWS_A_FILE", 200)
    assert common.cut(df, 1000).rdd.getNumPartitions() == max(cores, 5)
    assert common.cut(df, 400 * cores).rdd.getNumPartitions() == 2 * cores
    assert common.cut(df, 10**9).rdd.getNumPartitions() == 10 * cores and common.cut(df, 0).count() == 1000


def test_texts_reach_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 1000).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    key, old = common.MOST_BATCH_BYTES, spark.conf.get(common.MOST_BATCH_BYTES, None)
    uses = (lambda: signatures(docs, 5, "text"), lambda: train(docs, labels, 10), lambda: score_quality(docs, train(docs, labels, 10)))
    try:
        for use in uses:
            spark.conf.unset(key)
            use()
            most = max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
            assert most < 2 * common.BATCH_BYTES < 4000 * 5000
        spark.conf.set(key, "1000000")
        uses[0]()
        assert spark.conf.get(key) == "1000000"  # a session's own stays
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_mixing_takes_one_worker_a_task(spark, docs_of):
    docs = docs_of([(i, f"a{i} b c d", "xyz"[i % 3]) for i in range(60)])
    plan = mix_sources(docs, block_words=8, shards=4).pieces._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
