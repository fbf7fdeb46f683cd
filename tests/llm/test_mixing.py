import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stripewise.llm.mixing import draw_counts, mix_sources, mixed_documents, permuted, taken_words, water_fill

WORD = r"[^\x20\x09-\x0D]+"


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        a, b = (permuted(np.arange(n), np.full(n, n), np.full(n, k)) for k in (-5, 6))
        assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
        assert n < 100 or a.tolist() != b.tolist()
    mixed_sizes = permuted(np.array([0, 1, 4]), np.array([1, 2, 5]), np.array([3, 3, 3]))
    assert (mixed_sizes < np.array([1, 2, 5])).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    t = water_fill(sizes, weights)
    assert abs(sum(t) - sum(sizes)) < 1e-6 * (1 + sum(sizes))
    assert all(x <= 3 * n + 1e-9 for x, n in zip(t, sizes))
    free = [x / w for x, n, w in zip(t, sizes, weights) if x < 3 * n - 1e-9]
    assert not free or max(free) - min(free) < 1e-6 * (1 + max(free))


def test_draws_keep_to_their_room():
    got = draw_counts([300.0, 20.5, 30.0], [200, 21, 200], 8, 7)
    assert (got.sum(axis=0) <= [200, 21, 200]).all() and got.sum() == 350
    assert (draw_counts([0.0], [0], 4, 7) == 0).all()


def test_mix(docs_of):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40 + i % 60)), f"s{i % 5}" if i % 5 else None) for i in range(400)]
    docs = docs_of(rows, parts=5)
    mix = mix_sources(docs, block_words=16, shards=8)
    got = taken_words(mix).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = dict(zip(order, water_fill([sizes[s] for s in order], [1 + i % 3 for i in range(5)])))
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) < 0.05 * want[s] + 32
    assert all(r.taken <= 3 * r.size for r in got)
    again = {r.doc_id: r.taken for r in taken_words(mix_sources(docs, block_words=16, shards=8)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    pieces = mix.pieces.collect()
    per_block = Counter((p.shard, p.slot) for p in pieces)
    assert max(per_block.values()) <= 16
    words = Counter()
    for p in pieces:
        words[p.doc_id] += p.length
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    out = mixed_documents(mix)
    assert out.columns == docs.columns
    texts = Counter()
    for r in out.collect():
        texts[r.doc_id] += len(re.findall(WORD, r.text))
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split())
    assert texts == words


def test_awkward(awkward, empty):
    mix = mix_sources(awkward)
    got = taken_words(mix).collect()
    assert len(got) == awkward.count()
    assert sorted(r.size for r in got) == sorted(len(re.findall(WORD, r.text or "")) for r in awkward.collect())
    assert all(r.taken <= 3 * r.size for r in got)
    mixed_documents(mix).collect()
    assert taken_words(mix_sources(empty)).count() == 0


def permute(x, n, key):
    """One index through the permutation, in whole numbers."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(4):
            f = (right + key * 0x9E3779B97F4A7C15 + r + 1) * 0xBF58476D1CE4E5B9 % 2**64
            f ^= f >> 29
            f = f * 0x94D049BB133111EB % 2**64
            f ^= f >> 32
            left, right = right, left ^ (f & mask)
        x = left << half | right
        if x < n:
            return x


def test_against_a_replay_slot_by_slot(spark, docs_of):
    """Counts, both permutations and the join by index, replayed with lists of words."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(int(rng.integers(0, 90)))), [None, "a", "b", "c"][int(rng.integers(0, 4))]) for i in range(120)]
    words, shards, seed = 8, 5, 7
    mix = mix_sources(docs_of(rows, parts=4), block_words=words, shards=shards, seed=seed)
    text = {i: t.split() for i, t, _ in rows}
    streams = {}
    for r in sorted(mix.documents.collect(), key=lambda r: r.row):
        streams.setdefault(r.source, []).extend(text[r.doc_id])
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    sizes = [len(streams[s]) for s in names]
    targets = water_fill(sizes, [[1.0, 2.0, 3.0][i % 3] for i in range(len(names))])
    blocks = [-(-n // words) for n in sizes]
    drawn = draw_counts([t * b / n for t, b, n in zip(targets, blocks, sizes, strict=True)], [3 * b for b in blocks], shards, seed)
    keys = spark.range(shards * len(names) * 4).selectExpr("cast(id as int) AS x", "cast(id div 4 as int) AS s", "id % 4 AS e")
    keys = keys.selectExpr("x", "s", "e", f"xxhash64({seed}, x) AS of_shard", f"xxhash64({seed + 1}, s, e) AS of_pass").collect()
    of_shard, of_pass = {r.x: r.of_shard % 2**64 for r in keys}, {(r.s, r.e): r.of_pass % 2**64 for r in keys}
    want = {}
    for k in range(shards):
        place = 0
        for s, name in enumerate(names):
            for i in range(int(drawn[k, s])):
                draw = int(drawn[:k, s].sum()) + i
                block = permute(draw % blocks[s], blocks[s], of_pass[s, draw // blocks[s]])
                slot = permute(place + i, int(drawn[k].sum()), of_shard[k])
                want[k, slot] = (name, block, streams[name][block * words : (block + 1) * words])
            place += int(drawn[k, s])
    got = {}
    for r in sorted(mix.pieces.collect(), key=lambda r: (r.shard, r.slot, r.row)):
        got.setdefault((r.shard, r.slot), (r.source, r.block, []))[2].extend(text[r.doc_id][r.start : r.start + r.length])
    assert got == want
