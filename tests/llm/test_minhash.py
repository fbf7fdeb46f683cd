import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stripewise.llm import minhash
from stripewise.llm.common import table
from stripewise.llm.components import components
from stripewise.llm.minhash import drop_near_copies, near_duplicates, similar


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, percent):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def copies(docs_of):
    """Copies of a few texts with one word in many to few changed, some from copies of copies,
    a passage that unlike texts share, and unlike texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(6)]
    passage = [rng.choice(words) for _ in range(60)]
    for n in range(420):
        t = list(texts[n % 6]) if n % 3 else list(rng.choice(rows)[1].split() if rows else texts[0])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8, 12])):
            t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
        rows.append((n * 7 % 1009, " ".join(t)))
    for n in range(40):
        rows.append((2000 + n, " ".join(passage + [f"own{n}_{i}" for i in range(rng.randint(5, 60))])))
    return rows


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(docs_of, copies, width, percent):
    got = near_duplicates(docs_of([(*r, "s") for r in copies], parts=4), width, percent)
    assert result(got) == brute(copies, width, percent)
    rows = got.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(r.first for r in rows) == len({r.component_id for r in rows})


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(near_duplicates(docs, 3, 85)) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_awkward(awkward, empty):
    got = near_duplicates(awkward, 3, 85)
    rows = got.collect()
    assert len(rows) == awkward.count()
    assert sorted(r.n_shingles for r in rows) == sorted(len(shingles(r.text, 3)) for r in awkward.collect())
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    by_id = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by_id[5] == by_id[6] == 4 and by_id[9] == 8
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 7").count() == 1
    assert near_duplicates(empty).count() == 0 and drop_near_copies(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1), st.integers(1, 100))
def test_similar(a, b, percent):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    assert similar(x, y, percent) == (100 * len(a & b) >= percent * len(a | b))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for s in sorted(near):
        stack = [s]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                want[x] = s
                stack += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [24, 30, 50, 70, 80, 85, 95, 100])
def test_needed_holds_the_bound(percent):
    """By the exact binomial tail, and one more coordinate would break the bound."""
    m, p = minhash.needed(percent), percent / 100
    tail = lambda k: sum(math.comb(minhash.K, i) * p**i * (1 - p) ** (minhash.K - i) for i in range(k))
    assert 1 <= m <= minhash.K and tail(m) <= minhash.MISS
    assert m == minhash.K or tail(m + 1) > minhash.MISS


def test_too_low_a_percentage(docs_of):
    with pytest.raises(ValueError):
        near_duplicates(docs_of([(1, "a b c", "s"), (2, "a b d", "s")]), 2, 10)


def test_low_percentage_against_all_pairs(docs_of, copies):
    got = near_duplicates(docs_of([(*r, "s") for r in copies[:160]], parts=4), 3, 55)
    assert result(got) == brute(copies[:160], 3, 55)


@pytest.mark.parametrize("most_sent", [100_000, 0])
@pytest.mark.parametrize("centre", [0, 10**6])
def test_a_star_is_split(spark, centre, most_sent, monkeypatch):
    """A node with 20,000 links, as the least id or the largest: its rows are spread over tasks."""
    from stripewise.llm import components as module
    from stripewise.llm.components import meet

    monkeypatch.setattr(module, "MOST_SENT", most_sent)
    ids = spark.range(1, 20_001).select("id")
    links = ids.select(F.greatest("id", F.lit(centre)).alias("a"), F.least("id", F.lit(centre)).alias("b")).repartition(8)
    got = components(links).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(min(centre, 1), 20_001)]
    values = spark.createDataFrame([(centre, 20_000, 5)], "k long, n long, m long")
    rows = spark.range(20_000).select(F.lit(centre).alias("k"), "id").repartition(8)
    met = meet(rows, values, "k", 20_000)
    each = met.groupBy(F.spark_partition_id()).count().collect()
    assert met.columns == ["k", "id", "m"] and len(each) == 8 and max(r["count"] for r in each) < 5000


def test_a_cluster_of_many_unlinked_copies(docs_of):
    """Texts that share two thirds with a hub but too little with each other, and pairs among them."""
    rng = random.Random(9)
    trunk = [f"t{i}" for i in range(90)]
    rows = [(0, " ".join(trunk + [f"h{i}" for i in range(10)]))]
    for n in range(1, 700):
        rows.append((n, " ".join(trunk + [f"x{n if n % 7 else n // 14}_{i}" for i in range(rng.choice([20, 30, 45]) if n % 7 else 30)])))
    assert result(near_duplicates(docs_of([(*r, "s") for r in rows], parts=4), 3, 85)) == brute(rows, 3, 85)
