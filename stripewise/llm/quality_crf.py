"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are shares of byte classes and of repeated words, its
own and those of the lines before and behind it; transitions tie neighbours. The marginals of
forward-backward, weighted by the lines' lengths, add up to the quality of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.llm.common import small_batches

SAMPLE_DOCS = 4000  # labelled documents that the model is fitted on at most
STEPS, WARM, ROUND = 250, 100, 25
TRUST = 0.7  # chance that a line has its text's label
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _classes() -> np.ndarray:
    """Byte -> number of its class; the shares of all but the last in a line are features."""
    out = np.full(256, 9, np.uint8)
    for k, signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#*$%&", b"|<>", bytes(range(128, 256)))):
        out[list(signs)] = k
    out[_SPACE] = 8
    return out


_CLASS = _classes()
_N_SHARES = 9
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
OWN = _N_SHARES + 6
FEATURES = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts, one after the other: features, lengths; and lines per text.

    An empty text has one empty line. Works on the bytes of all texts at once."""
    blob = b"\n".join(texts) + b"\n"
    b = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    per_text = np.diff(np.searchsorted(ends, text_ends, side="right"), prepend=0)
    n = len(ends)
    length = (ends - starts).astype(np.float64)
    line_of = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(line_of * 10 + _CLASS[b], minlength=10 * n).reshape(n, 10).astype(np.float64)
    counts[:, 8] -= 1  # the line's own end
    size = np.maximum(length, 1)[:, None]

    space = _SPACE[b]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    words = np.bincount(line_of[first], minlength=n).astype(np.float64)
    again = np.zeros(n)
    distinct = np.zeros(n)
    line_hash = np.zeros(n, np.uint64)
    if len(first):
        mixed = _MIX[b]
        mixed[space] = 0
        h = np.add.reduceat(mixed, first)  # the signs of a word in any order, which is enough here
        at = line_of[first]
        same = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        again = np.bincount(at[1:][same], minlength=n).astype(np.float64)
        with np.errstate(over="ignore"):
            key = h * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)
        _, once = np.unique(key, return_index=True)
        distinct = np.bincount(at[once], minlength=n).astype(np.float64)
        np.add.at(line_hash, at, h)
    some = np.maximum(words, 1)
    own = np.concatenate(
        [
            counts[:, :_N_SHARES] / size,
            np.log1p(length)[:, None],
            np.log1p(words)[:, None],
            ((length - counts[:, 8]) / some)[:, None].clip(0, 30) / 10,
            (again / some)[:, None],
            (distinct / some)[:, None],
            (words == 0).astype(np.float64)[:, None],
        ],
        axis=1,
    )
    last = np.cumsum(per_text) - 1
    head = np.zeros(n, bool)
    head[last - per_text + 1] = True
    tail = np.zeros(n, bool)
    tail[last] = True
    before = np.roll(own, 1, axis=0)
    before[head] = 0
    behind = np.roll(own, -1, axis=0)
    behind[tail] = 0
    copy = (line_hash == np.roll(line_hash, 1)) & ~head & (words > 0)
    x = np.concatenate([own, before, behind, head[:, None], tail[:, None], copy[:, None]], axis=1)
    return x.astype(np.float32), length + 1, per_text


def marginals(unary: np.ndarray, moves: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts side by side: P(good) of each line, the expected moves
    (from, to), and the log partition sum. unary: log potential of good against bad."""
    order = np.argsort(-per_text, kind="stable")
    sizes = per_text[order]
    start = (np.cumsum(per_text) - per_text)[order]
    n, longest = len(unary), int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    pot = np.exp(np.stack([-unary / 2, unary / 2], axis=1) - np.abs(unary / 2)[:, None])
    fwd, bwd, scale = np.zeros((n, 2)), np.ones((n, 2)), np.zeros(n)
    step = np.exp(moves)
    for t in range(longest):
        at = start[: alive[t]] + t
        a = pot[at] if t == 0 else (fwd[at - 1] @ step) * pot[at]
        s = a.sum(axis=1)
        fwd[at], scale[at] = a / s[:, None], s
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        m = (bwd[at + 1] * pot[at + 1]) @ step.T
        bwd[at] = m / scale[at + 1][:, None]
    post = fwd * bwd
    post /= post.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[(np.cumsum(per_text) - per_text)[per_text > 0]] = False
    i = np.flatnonzero(inner)
    pair = fwd[i - 1][:, :, None] * step[None] * (bwd[i] * pot[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return post[:, 1], pair.sum(axis=0), float(np.log(scale).sum() + np.abs(unary / 2).sum())


@dataclass(frozen=True)
class LineField:
    """The fitted field: a few dozen numbers."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray  # the last is the bias
    moves: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std).clip(-8, 8) @ self.weights[:-1] + self.weights[-1]

    def _long(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """unary, weights and lines of one text, made piece by piece: a piece is whole lines of
        about CHUNK_BYTES, looked at with the line before and the line behind it."""
        unary, weights, at = [], [], 0
        while at <= len(text):
            end = text.rfind(b"\n", at, at + CHUNK_BYTES)
            end = end if end >= at else text.find(b"\n", at)
            end = end if end >= 0 else len(text)
            before = text.rfind(b"\n", 0, max(0, at - 1)) + 1 if at else 0
            behind = text.find(b"\n", end + 1) if end < len(text) else end
            x, weight, per_text = line_features([text[before : behind if behind >= 0 else len(text)]])
            own = slice(int(at > 0), per_text[0] - int(end < len(text)))
            unary.append(self.unary(x[own]))
            weights.append(weight[own])
            at = end + 1
        return np.concatenate(unary), np.concatenate(weights), np.array([sum(map(len, unary))])

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Of each text; one of more than CHUNK_BYTES should come alone."""
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            unary, weight, per_text = self._long(texts[0])
        else:
            x, weight, per_text = line_features(texts)
            unary = self.unary(x)
        good, _, _ = marginals(unary, self.moves, per_text)
        first = np.cumsum(per_text) - per_text
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def fit(x: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS, l2: float = 1e-3, trust: float = TRUST) -> LineField:
    """Generalised expectation maximisation, the lines' labels being hidden: a text's label is seen
    through each of its lines, which has that label with odds of trust. Expectations of labels and
    moves given the texts' labels are the targets of Adam steps on the whole sample. The first WARM
    steps begin with every line labelled as its text; then expectations are taken from the field
    every ROUND steps, so that a good line of a bad text may be one, and moves are learnt."""
    mean, std = x.mean(axis=0).astype(np.float64), x.std(axis=0).astype(np.float64) + 1e-3
    z = np.concatenate([((x - mean) / std).clip(-8, 8), np.ones((len(x), 1))], axis=1)
    share = np.repeat(1.0 / per_text, per_text)  # a text counts once, however long it is
    inner = max(1, int((per_text - 1).sum()))
    target = np.repeat(labels.astype(np.float64), per_text)
    seen = np.diag([((per_text - 1) * (labels == v)).sum() for v in (0, 1)]).astype(np.float64)
    lean = np.repeat(np.where(labels == 1, 1.0, -1.0), per_text) * np.log(trust / (1 - trust))
    w, moves = np.zeros(z.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for k in range(1, steps + 1):
        if k > WARM and k % ROUND == 1:
            target, seen, _ = marginals(z @ w + lean, moves, per_text)
        p, pairs, _ = marginals(z @ w, moves, per_text)
        gw = z.T @ ((p - target) * share) / len(labels) + l2 * w
        gm = (pairs - seen) / inner + 10 * l2 * moves
        rate = 0.1 * (1 - 0.9 * k / steps)
        for i, (v, g) in enumerate(((w, gw), (moves, gm))):
            m, s = state[2 * i], state[2 * i + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return LineField(mean, std, w, moves)


def fold(id_: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> LineField | None:
    """A field fitted on at most sample_docs labelled documents outside the held-out fold, the
    first by a hash of their id; their lines' features are made on the executors. Ids without
    or with a null label are left out, several labels of an id count as their least. None if
    the sample lacks one of the two labels."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample_docs)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v or b"" for v in batch.column(1).to_pylist()]
            if texts:
                x, _, per_text = line_features(texts)
                cuts = np.cumsum(per_text) - per_text
                raw = [x[a : a + n].tobytes() for a, n in zip(cuts, per_text, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["label", "x"])

    rows = (
        docs.select(F.col(id_col).alias("__id"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
        .join(F.broadcast(chosen), "__id")  # sample_docs rows at most
        .select("label", "raw")
        .mapInArrow(features, "label int, x binary")
        .collect()
    )
    rows = sorted((r["label"], bytes(r["x"])) for r in rows)  # tasks end in any order
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows])
    return fit(x, np.array([len(r[1]) // 4 // FEATURES for r in rows]), y)


def score_quality(
    docs: DataFrame, field: LineField | None, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """docs with score_col (0 to 1) added; whole texts, no shuffle. The columns of docs stay; one
    named score_col is replaced. Null and empty texts are one empty line; repeated rows and null
    ids are scored like any other row; an empty table gives no rows. Without a field (the
    labels had one value only) every score is 0.5."""
    schema = T.StructType([*(f for f in docs.schema if f.name != score_col), T.StructField(score_col, T.DoubleType())])
    plain = docs.drop(score_col)
    if field is None:
        return plain.withColumn(score_col, F.lit(0.5))
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            out: list[np.ndarray] = []
            held: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                raw = (texts[i].as_py() or "").encode()
                if held and len(raw) > CHUNK_BYTES:
                    out.append(field.quality(held))
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    out.append(field.quality(held))
                    held, size = [], 0
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return plain.mapInArrow(score, schema)
