import re
from collections import Counter

from stripewise.llm.common import table
from stripewise.llm.quality_rules import Rule, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)


def test_base_measures(spark, awkward, docs_of):
    loop = "a b c d e f g h i j " * 3
    more = docs_of([(1, loop, "s"), (2, loop + " ".join(map(str, range(100))), "s"), (3, "k " * 60, "s"), (4, "a b c d e f g h", "s"), (5, "a b c d e f g h " * 2, "s")])
    for docs in (awkward, more, table(spark, "/root/testdata/sf0.001", "documents")):
        got = quality_rules(docs).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted(tuple(r[c] for c in names) for r in got) == sorted(brute(r.text) for r in docs.collect())
        assert not any(r.kept and r.base_failed for r in got)
        assert all(r.kept == (not r.failed_rules) for r in got)


def test_rules_and_plan(docs_of, empty):
    prose = "the " * 3 + " ".join(f"word{i} of" for i in range(30))
    docs = docs_of([(1, prose, "s"), (2, " ".join(f"word{i}***|" for i in range(40)), "s")])
    got = {r.doc_id: r.failed_rules for r in quality_rules(docs).collect()}
    assert got[1] == [] and set(got[2]) == {"symbols", "stop_words"}
    strict = quality_rules(docs, (Rule("length", "mean_word_length", None, 2.0),))
    assert {r.doc_id: r.failed_rules for r in strict.collect()} == {1: ["length"], 2: ["length"]}
    plan = quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1
    assert quality_rules(empty).count() == 0


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    good = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")
    n = good.count()
    assert quality_rules(good).where("kept or n_words < 20").count() >= 0.98 * n


def test_low_quality_documents_go(spark):
    """Those of labels that a fit on four fifths would not see: the values are not fitted at all."""
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").where("doc_id % 5 = 1 and quality is not null")
    judged = quality_rules(table(spark, d, "documents").join(labels, "doc_id", "left_semi")).join(labels, "doc_id")
    judged = judged.where("n_words >= 20").cache()
    low, good = judged.where("quality = 0"), judged.where("quality = 1")
    assert low.count() > 50 and low.where("not kept").count() >= 0.95 * low.count()
    assert good.where("kept").count() >= 0.98 * good.count()
    menu = " ".join(f"dishname{i} | of {i}.50 |" for i in range(30))
    assert quality_rules(spark.createDataFrame([(1, menu)], "doc_id long, text string")).first().failed_rules == ["symbols", "letters"]


def test_published_rules_equal_their_sql(spark):
    import duckdb

    from stripewise.llm.oracles import ORACLES
    from stripewise.llm.queries import QUERIES

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    for name in ("op10_quality_rules", "op10_quality_rules_published"):
        got = QUERIES[name](spark, d)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(ORACLES[name]).fetchall(), key=repr)
