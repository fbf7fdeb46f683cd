import itertools
import zlib

import numpy as np
import pytest

from stripewise.llm.common import table
from stripewise.llm.quality_crf import FEATURES, HELD_OUT, fit, line_features, marginals, score_quality, train

D = "/root/testdata/sf0.01"


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    per_text = np.array([1, 4, 3])
    unary, moves = rng.normal(size=8) * 2, rng.normal(size=(2, 2))
    p, pairs, logz = marginals(unary, moves, per_text)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        u = unary[at : at + n]
        total, mass, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum((u[i] / 2 if y[i] else -u[i] / 2) for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                trans[a, b] += w
        want += (mass / total).tolist()
        want_pairs += trans / total
        want_z += np.log(total)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(logz, want_z)


def test_features():
    x, weight, per_text = line_features([b"", b"a b\n\nA!! A!!", "é".encode()])
    assert per_text.tolist() == [1, 3, 1] and x.shape == (5, FEATURES) and weight.tolist() == [1, 4, 1, 8, 3]
    one, _, _ = line_features([b"a b\n\nA!! A!!"])
    assert np.allclose(x[1:4], one)


def test_neighbours_decide_an_unclear_line():
    good, bad = b"plain prose of some words\nand more of it\nin lines", b"BUY!! BUY!! BUY!!\n### $$$ ***\nNOW!! NOW!!"
    x, _, n = line_features([good, bad] * 20)
    field = fit(x, n, np.array([1, 0] * 20), steps=100)
    a, b = field.quality([b"plain prose of some words\nand more of it", b"BUY!! BUY!!\nand more of it\n### $$$"])
    assert a > 0.9 and b < 0.5


def test_held_out_accuracy(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    scored = {r.doc_id: r.score for r in score_quality(docs, train(docs, labels)).select("doc_id", "score").collect()}
    held = [(scored[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == HELD_OUT]
    assert len(held) > 50
    right = np.mean([(s >= 0.7) == (q == 1) for s, q in held])
    kept = np.mean([s >= 0.7 for s, q in held if q == 1])
    assert right > 0.95 and kept > 0.97


def test_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1, 0), (12, 0, 0), (12, None, 1), (None, 1, 0), (7, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    field = train(awkward, labels)
    out = score_quality(awkward, field)
    assert sorted(out.columns) == sorted(awkward.columns)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(empty, field).count() == 0
    assert train(awkward, labels.where("quality = 1")) is None
    assert {r.score for r in score_quality(awkward, None).collect()} == {0.5}
    with pytest.raises(Exception):
        train(awkward.drop("text"), labels)


def test_lines_are_hidden():
    """Bad texts that are half prose: their prose lines may be good ones, and moves from good to bad
    lines are learnt, which no text whose lines all have its label could show."""
    prose = [f"plain prose of some {w} words and more of it" for w in "river stone field garden winter summer".split()]
    spam = [f"BUY!! {w} $$$ ### ***" for w in "NOW CHEAP FREE WIN CASH DEAL".split()]
    rng = np.random.default_rng(5)
    pick = lambda lines, n: [str(x) for x in rng.choice(lines, n)]
    good = ["\n".join(pick(prose, 6)).encode() for _ in range(60)]
    bad = ["\n".join(pick(prose, 5) + pick(spam, 5)).encode() for _ in range(40)]
    x, _, n = line_features(good + bad)
    labels, (one, _, n_one) = np.array([1] * 60 + [0] * 40), line_features(bad[:1])
    seen = {}
    for trust in (0.7, 0.9999):
        field = fit(x, n, labels, trust=trust)
        p, pairs, _ = marginals(field.unary(one), field.moves, n_one)
        seen[trust] = p, pairs[1, 0]
        assert field.quality(good[:5]).min() > 0.9 and field.quality(bad[:5]).max() < 0.2
    assert seen[0.7][0][:3].min() > 0.15 and seen[0.7][0][5:].max() < 0.01
    assert seen[0.7][1] > 0.25 and seen[0.7][1] > 1.1 * seen[0.9999][1]


def test_long_texts_piece_by_piece(monkeypatch):
    from stripewise.llm import quality_crf

    lines = [("good line %d of words" % i if i % 5 else ("" if i % 2 else "BUY!! ### $$$")) for i in range(4000)]
    lines[700] = lines[699]
    x, _, n = line_features([b"plain prose of words\nand more", b"BUY!! ###\n$$$ ***"] * 10)
    field = fit(x, n, np.array([1, 0] * 10), steps=60)
    for text in ("\n".join(lines), "\n".join(lines) + "\n", "x" * 300 + "\n" + "y z " * 200):
        want = field.quality([text.encode(), b""])[0]
        monkeypatch.setattr(quality_crf, "CHUNK_BYTES", 100)
        assert abs(field.quality([text.encode()])[0] - want) < 1e-6
        monkeypatch.undo()
