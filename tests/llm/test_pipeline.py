import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_minhash import brute

from stripewise.llm.common import table
from stripewise.llm.queries import vocabulary

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, D, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, D).cache()
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    labels = table(spark, D, "labels").where("quality = 1").select("doc_id")
    assert good.join(labels, "doc_id", "left_semi").count() >= 0.97 * docs.join(labels, "doc_id", "left_semi").count()

    single = stage["exact_dedup"](spark, good, D).cache()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in good.collect():
        groups.setdefault(plain(r.text), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g)[1] for g in groups.values())

    unlike = stage["near_dedup"](spark, single, D).cache()
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in single.collect()], 5, 80)}
    assert {r.doc_id for r in unlike.collect()} == want

    mixed = stage["mixing"](spark, unlike, D).cache()
    assert mixed.columns == docs.columns
    words = {r.doc_id: r.text.split() for r in unlike.collect()}
    assert all(set(r.text.split()) <= set(words[r.doc_id]) and r.n_chars == len(r.text) for r in mixed.collect())

    packed = stage["packing"](spark, mixed, D)
    total = packed.agg(F.sum("length")).first()[0]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    assert total == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 1024").count() <= 1
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in packed.limit(20).collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


def written(awkward, tmp_path, labels):
    """A folder of tables as the pipeline reads them: awkward documents and some labels."""
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    awkward.sparkSession.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_awkward_documents(spark, awkward, tmp_path):
    """Nulls, empty, very long and repeated rows, clashing columns; labels of one value only."""
    d = written(awkward.select("*", (1.5 * F.col("doc_id")).alias("__score")), tmp_path, [(i, 1, 0) for i in range(1, 12)])
    docs = table(spark, d, "documents")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, d)
    assert good.columns == docs.columns and good.count() == docs.count()
    assert [r.score for r in good.orderBy("doc_id", "text").collect()] == [0.5] * docs.count()
    out = corpus_pipeline.run(spark, d)
    texts = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()}
    assert 0 < out.select("doc_id").distinct().count() <= len(texts)


def test_both_labels_leave_other_columns_alone(spark, awkward, tmp_path):
    d = written(awkward, tmp_path, [(i, i % 2, 0) for i in range(1, 12)])
    docs = table(spark, d, "documents")
    good = dict(corpus_pipeline.STAGES)["quality"](spark, docs, d)
    assert good.columns == docs.columns and {r.score for r in good.collect()} <= {0.5}
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_empty_documents(spark, empty, tmp_path):
    d = written(empty, tmp_path, [])
    assert corpus_pipeline.run(spark, d).count() == 0
