import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stripewise.llm.common import table
from stripewise.llm import pitman_yor
from stripewise.llm.pitman_yor import SEED, binomial, pack, perplexity, score_texts, seat, unpack


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(rows, docs):
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_scores(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 300")
    scores = score_texts(docs)
    rows = scores.collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    again = {r.doc_id: r.score for r in score_texts(docs.repartition(3)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * abs(r.score) for r in rows)
    for r in perplexity(scores).collect():
        assert r.perplexity < r.base_perplexity


def test_awkward(awkward, empty):
    rows = score_texts(awkward).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.collect()])
    assert score_texts(empty).count() == 0
    assert score_texts(awkward, held=F.lit(True)).count() == awkward.count()


MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 31) * 0x94D049BB133111EB) & MASK
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ x >> 32


def come_back(c, others, s, d, parent, bits, trial):
    """Customers one by one, from 32 on in small blocks: tables, and the logs of those who sat
    down with others."""
    t, sits, seated = min(c, 1), [0.0] * len(trial), 1
    while seated < c:
        bits = mixed((bits + 0x9E3779B97F4A7C15) & MASK)
        block = min(max(1, seated // 16), c - seated)
        opening = (s + d * (others + t)) * parent(t)
        p, k = opening / (opening + seated - d * t), 0
        below = chance = (1 - p) ** block
        while (bits >> 11) / 2.0**53 > below and k < block:
            chance *= (block - k) / (k + 1) * p / (1 - p)
            k += 1
            below += chance
        sits = [x + (block - k) * math.log(seated + (block - 1) / 2 - e * t) for x, e in zip(sits, trial, strict=True)]
        t, seated = t + k, seated + block
    return t, sits


def brute(docs, sweeps=pitman_yor.SWEEPS):
    """Scores by a plain sampler, dish by dish and customer by customer; returns the sums of the
    predictive probabilities of each context as well."""
    from xxhash import xxh3_64_intdigest as digest

    pairs = lambda text: list(zip([b"\n"] + tokens(text), tokens(text)))
    c = Counter(p for i, t in docs if not held(i) for p in pairs(t))
    words, contexts = {w for _, w in c}, Counter()
    for (u, _), n in c.items():
        contexts[u] += n
    alike = 1 / (len(words) + 1)
    t, dishes = dict.fromkeys(c, 1), Counter(w for _, w in c)
    t0 = dict.fromkeys(words, 1)
    level = lambda x: [min(0.9, max(0.1, x[1] / max(1, x[1] + 2 * x[2]))), 1.0]
    low, high = level(Counter(c.values())), level(Counter(dishes.values()))
    grid = lambda v: (
        sorted({min(0.98, max(0.02, v[0] + x)) for x in (-0.1, -0.03, 0.0, 0.03, 0.1)}),
        sorted({min(1e4, max(0.05, v[1] * x)) for x in (0.25, 0.6, 1.0, 1.6, 4.0)}),
    )

    def opened(restaurants, trial):
        out = np.zeros((len(trial[0]), len(trial[1])))
        for i, d in enumerate(trial[0]):
            for j, s in enumerate(trial[1]):
                for tables, customers in restaurants:
                    out[i, j] += (tables - 1) * math.log(d) + math.lgamma(s / d + tables) - math.lgamma(s / d + 1)
                    out[i, j] -= math.lgamma(s + customers) - math.lgamma(s + 1)
        return out

    def draw(sits, log, trial, seed):
        log = np.array(sits)[:, None] + log
        p = np.exp(log - log.max()).ravel()
        k = int(np.random.default_rng(seed).choice(len(p), p=p / p.sum()))
        return [trial[0][k // len(trial[1])], trial[1][k % len(trial[1])]]

    kept, sums = {}, []
    for k in range(1, sweeps + 1):
        sent, total = Counter(), Counter()
        for (u, w), n in t.items():
            sent[w] += n
            total[u] += n
        customers, tables = sum(sent.values()), sum(t0.values())
        new = (high[1] + high[0] * tables) * alike
        trial, high_trial = grid(low), grid(high)
        sits, high_sits, now, now0 = [0.0] * len(trial[0]), [0.0] * len(high_trial[0]), {}, {}
        for (u, w), n in c.items():
            mine = t[u, w]
            left = sent[w] - mine
            at = min(t0[w], left)
            parent = lambda x: (max(left + x - high[0] * max(at, 1), 0) + new) / (high[1] + customers - mine + x)  # noqa: E731, B023
            bits = mixed((mixed((digest(w) + 2 * k) & MASK) + mixed(digest(u)) + 1) & MASK)
            now[u, w], more = come_back(n, total[u] - mine, low[1], low[0], parent, bits, trial[0])
            sits = [a + b for a, b in zip(sits, more, strict=True)]
        t, sent, total = now, Counter(), Counter()
        for (u, w), n in t.items():
            sent[w] += n
            total[u] += n
        for w in words:
            now0[w], more = come_back(sent[w], tables - t0[w], high[1], high[0], lambda _: alike, mixed((digest(w) + 2 * k) & MASK), high_trial[0])
            high_sits = [a + b for a, b in zip(high_sits, more, strict=True)]
        t0 = now0
        customers, tables = sum(sent.values()), sum(t0.values())
        low = draw(sits, opened([(total[u], contexts[u]) for u in contexts], trial), trial, (SEED, k, 0))
        high = draw(high_sits, opened([(tables, customers)], high_trial), high_trial, (SEED, k, 1))
        if k > pitman_yor.BURN_IN:
            (d, s), (d0, s0), mine, in_words = low, high, dict(t), dict(t0)
            new = (s0 + d0 * tables) * alike

            def probability(u, w, d=d, s=s, d0=d0, s0=s0, mine=mine, in_words=in_words, sent=sent, total=total, new=new, customers=customers):
                word = (max(sent[w] - d0 * in_words.get(w, 0), 0) + new) / (s0 + customers)
                own = max(c[u, w] - d * mine.get((u, w), 0), 0)
                return (own + (s + d * total[u]) * word) / (s + contexts[u])

            kept[k] = probability
            sums += [sum(probability(u, w) for w in words | {b" unknown"}) for u in contexts]
    score = lambda text: sum(math.log10(sum(f(u, w) for f in kept.values()) / len(kept)) for u, w in pairs(text))
    return {i: score(t) for i, t in docs}, sums


def ten_texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[min(29, int(x))] for x in rng.exponential(5, size=20 + 9 * i)), "s") for i in range(10)]
    return [*rows, (11, rows[3][1], "s"), (16, rows[5][1], "s"), (12, "never seen words w1", "s"), (13, "", "s")]


def test_against_a_plain_sampler(docs_of):
    rows = ten_texts()
    want, sums = brute([r[:2] for r in rows])
    assert np.allclose(sums, 1)
    got = {r.doc_id: r.score for r in score_texts(docs_of(rows)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-4 * max(1, abs(want[i])) for i in want)
    assert {i for i in want if held(i)}


def test_parts_and_hot_words_do_not_matter(spark, docs_of, monkeypatch):
    docs = docs_of([(i, t, "s") for i, t in enumerate([r[1] for r in ten_texts()] * 3)], parts=5)
    one = {r.doc_id: r for r in score_texts(docs).collect()}
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 300)
    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 40)
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 400)
    many = {r.doc_id: r for r in score_texts(docs).collect()}
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert abs(r.score - many[i].score) < 1e-4 * abs(r.score)
        assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) == (many[i].n_tokens, many[i].n_known, many[i].train_tokens, round(many[i].base_score, 6))


def test_held_out_copies_score_higher(docs_of):
    """Texts that were also trained on are far likelier than texts of the same words."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(80)]
    ids = [i for i in range(1000) if held(i)][:40], [i for i in range(1000) if not held(i)][:60]
    rows = [(i, t, "s") for i, t in zip(ids[1], texts[:60], strict=True)]
    rows += [(i, t, "s") for i, t in zip(ids[0], texts[:20] + texts[60:], strict=True)]
    got = {r.doc_id: r.score / r.n_tokens for r in score_texts(docs_of(rows)).collect()}
    assert min(got[i] for i in ids[0][:20]) > max(got[i] for i in ids[0][20:])


def test_seating():
    def tables(c, opening, n=400):
        k = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        parent = lambda t, _: opening / (1 + 0.5 * t)  # noqa: E731  (so that the odds of a new table stand)
        return seat(np.full(n, c), np.zeros(n), 1.0, 0.5, parent, np.zeros((1, n)), k, np.array([0.5]))[0]

    assert (seat(np.array([0, 1]), np.zeros(2), 1.0, 0.5, lambda t, _: 0.1, np.zeros((1, 2)), np.zeros(2, np.uint64), np.array([0.5]))[0] == [0, 1]).all()

    def expected(a, c):
        e = [1.0] + [0.0] * c
        for i in range(1, c):
            nxt = [0.0] * (c + 1)
            for t in range(1, i + 1):
                p = a / (a + i - 0.5 * t)
                nxt[t - 1] += e[t - 1] * (1 - p)
                nxt[t] += e[t - 1] * p
            e = nxt
        return sum((t + 1) * x for t, x in enumerate(e))

    for opening, c in ((0.1, 50), (10.0, 50), (3.0, 300)):
        got = tables(c, opening)
        assert (got >= 1).all() and (got <= c).all() and got.std() > 0
        assert abs(got.mean() - expected(opening, c)) < 4 * got.std() / 20 + 0.03 * expected(opening, c)
    huge = seat(np.array([10**9]), np.zeros(1), 1.0, 0.5, lambda t, _: 1e-3, np.zeros((1, 1)), np.zeros(1, np.uint64), np.array([0.5]))[0]
    assert 1 <= huge[0] < 10**9


def test_binomial_draws():
    u = (np.arange(20_000) + 0.5) / 20_000
    for n, p in ((1, 0.3), (7, 0.9), (40, 0.1), (1000, 0.2), (10**6, 0.5)):
        x = binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert (x >= 0).all() and (x <= n).all() and (x == np.rint(x)).all()
        assert abs(x.mean() - n * p) < 0.02 * max(1, n * p) and abs(x.std() - math.sqrt(n * p * (1 - p))) < 0.03 * max(1, math.sqrt(n * p * (1 - p)))


def test_packed_arrays():
    for x in (np.zeros(0, np.int32), np.arange(1000) - 500, np.array([2**31 - 1, -(2**31)])):
        assert (unpack(pack(x)) == x).all()
    assert (unpack(pack(np.array([2**40]), "<i8"), "<i8") == [2**40]).all()
