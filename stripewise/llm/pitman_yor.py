"""Language-model scores from a hierarchical Pitman-Yor model of words after words.

Restaurants: one for each previous word, whose dishes are the words behind it, over the word
restaurant that all of them share as parent, over a base that holds the training words and one
unknown word alike, the events of the unigram model that scores are compared with. A customer is
an occurrence in a training text; each table of a context's restaurant sends a customer to the
word restaurant. The restaurant of the first word of a text is that of the end token.

The seating is sampled by Gibbs. In a sweep every dish's customers leave their restaurant and
come back one by one, given the seating of all other dishes after the sweep before (its own
tables, and the customers that they sent to the parent, are taken out first), as in parallel
Gibbs sampling of topic models: dishes of one sweep do not see each other's moves. Discount and
strength of both levels are drawn after each sweep from a grid about their last values.

Pairs of words are counted per chunk of texts, dealt into parts by the second word, and merged
there; a part keeps its pairs, packed, in a bucketed table, so that sweeps read them in place.
What goes around in a sweep is one number for each part and context: tables up, their total down.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripewise.llm.common import delete_at_end, shared_dir, stored

SWEEPS, BURN_IN = 3, 1
FOLDS, HELD_OUT = 5, 1
CHUNK_BYTES = 8 << 20
PART_TOKENS = 2_000_000
MOST_BUCKETS = 20_000
HOT_SHARE = 4096  # a word with more than this part of all tokens is dealt to all parts
SLICE = 400_000  # dishes seated at once
END = b"\n"  # no word holds it
SEED = 11


# Packed arrays: the bytes of all numbers by significance, compressed.


def pack(x: np.ndarray, kind: str = "<i4") -> bytes:
    x = np.ascontiguousarray(x.astype(kind))
    raw = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind: str = "<i4") -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of hashes each is in; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


# Seating.


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws of how many of n succeed with chance p, from uniform u: by inversion where few are
    expected, else by the normal law."""
    p = np.clip(p, 0.0, 1 - 1e-12)
    mean = n * p
    out = np.zeros(len(n))
    few = np.flatnonzero(mean < 12)
    m, q, v = n[few], p[few], u[few]
    chance = np.exp(m * np.log1p(-q))
    below, k, open_ = chance.copy(), np.zeros(len(few)), v > chance
    while open_.any():
        i = np.flatnonzero(open_)
        chance[i] *= (m[i] - k[i]) / (k[i] + 1) * q[i] / (1 - q[i])
        k[i] += 1
        below[i] += chance[i]
        open_[i] = (v[i] > below[i]) & (k[i] < m[i]) & (chance[i] > 1e-300)
    out[few] = k
    many = np.flatnonzero(mean >= 12)
    if len(many):
        spread = np.sqrt(mean[many] * (1 - p[many]))
        out[many] = np.clip(np.rint(mean[many] + spread * _normal(u[many])), 0, n[many])
    return out


def _normal(u: np.ndarray) -> np.ndarray:
    """The value that a normal deviate stays under with chance u, by bisection."""
    lo, hi = np.full(len(u), -9.0), np.full(len(u), 9.0)
    for _ in range(40):
        x = (lo + hi) / 2
        # The normal law by a series of Zelen and Severo, good to 1e-7.
        k = 1 / (1 + 0.2316419 * np.abs(x))
        tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
        under = np.where(x >= 0, 1 - tail, tail) < u
        lo, hi = np.where(under, x, lo), np.where(under, hi, x)
    return (lo + hi) / 2


def seat(
    customers: np.ndarray, others: np.ndarray, strength: float, discount: float, parent: Callable, rest: np.ndarray, bits: np.ndarray, trial: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish after its customers came back, and for each discount in trial the log
    of the chances of those who sat down at a table with the dish.

    A customer opens a table with odds of (strength + discount * tables) * parent against seated
    customers less discount per table. others: tables of the restaurant's other dishes;
    parent(tables, rest): the parent's probability of the dish when so many of its tables have
    sent customers; rest: its arguments, a column for each dish. While under 32 are seated they
    come singly, then in blocks of a sixteenth of those seated, within which the odds stand. bits:
    64 for each dish, from which all its draws follow, wherever it is computed."""
    tables = np.minimum(customers, 1).astype(np.float64)
    sits = np.zeros(len(trial))
    for at in range(0, len(customers), SLICE):
        todo = at + np.flatnonzero(customers[at : at + SLICE] > 1)
        c, o, r, x = customers[todo].astype(np.float64), others[todo].astype(np.float64), rest[:, todo], bits[todo].copy()
        t, seated = np.ones(len(todo)), np.ones(len(todo))
        while len(todo):
            x = _mixed(x + np.uint64(0x9E3779B97F4A7C15))
            u = (x >> np.uint64(11)).astype(np.float64) / 2.0**53
            block = np.minimum(np.maximum(1, np.floor(seated / 16)), c - seated)
            opening = (strength + discount * (o + t)) * parent(t, r)
            new = binomial(block, opening / (opening + np.maximum(seated - discount * t, 1e-12)), u)
            middle = seated + (block - 1) / 2
            for j, d in enumerate(trial):
                sits[j] += ((block - new) * np.log(np.maximum(middle - d * t, 1e-12))).sum()
            t += new
            seated += block
            done = seated >= c
            if done.any():
                tables[todo[done]] = t[done]
                keep = ~done
                todo, c, o, r, x, t, seated = todo[keep], c[keep], o[keep], r[:, keep], x[keep], t[keep], seated[keep]
    return tables, sits


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def openings(tables: np.ndarray, customers: np.ndarray, level: "Level") -> np.ndarray:
    """Log of the chances of the tables opened in restaurants, and of the customers' total, for
    each trial discount (rows) and strength (columns) of the level."""
    both, times = np.unique(np.stack([tables, customers]), axis=1, return_counts=True)
    t, c = both[:, both[0] > 0].astype(np.float64)
    times = times[both[0] > 0]
    out = np.zeros((len(level.discounts), len(level.strengths)))
    for j, s in enumerate(level.strengths):
        total = (times * (_lgamma(c + s) - _lgamma(np.full(len(c), s + 1.0)))).sum()
        for i, d in enumerate(level.discounts):
            opened = (t - 1) * np.log(d) + _lgamma(s / d + t) - _lgamma(np.full(len(t), s / d + 1.0))
            out[i, j] = (times * opened).sum() - total
    return out


@dataclass(frozen=True)
class Level:
    """Discount and strength of the restaurants of a level."""

    discount: float
    strength: float

    @property
    def discounts(self) -> np.ndarray:
        return np.unique(np.clip(self.discount + np.array([-0.1, -0.03, 0.0, 0.03, 0.1]), 0.02, 0.98))

    @property
    def strengths(self) -> np.ndarray:
        return np.unique(np.clip(self.strength * np.array([0.25, 0.6, 1.0, 1.6, 4.0]), 0.05, 1e4))

    def drawn(self, sits: np.ndarray, opened: np.ndarray, seed: tuple[int, ...]) -> "Level":
        """The next values, by their chances given the seating (a griddy Gibbs step)."""
        log = sits[:, None] + opened
        p = np.exp(log - log.max()).ravel()
        k = int(np.random.default_rng(seed).choice(len(p), p=p / p.sum()))
        i, j = divmod(k, opened.shape[1])
        return Level(float(self.discounts[i]), float(self.strengths[j]))


@dataclass(frozen=True)
class State:
    """What the parts need to know of the whole after a sweep: some numbers, and the customers
    and tables of the words dealt to all parts."""

    contexts: Level
    words: Level
    customers: float  # of the word restaurant
    tables: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def base(self, distinct: int) -> float:
        return (self.words.strength + self.words.discount * self.tables) / (distinct + 1)


@dataclass
class Part:
    """A part's pairs, by the hashes of word and previous word (words, contexts): pairs of each word,
    the previous word's place among contexts and the training count of each pair; and which words
    are dealt to all parts, as places and as numbers among them."""

    words: np.ndarray
    contexts: np.ndarray
    runs: np.ndarray
    context: np.ndarray
    count: np.ndarray
    hot_word: np.ndarray
    hot_number: np.ndarray

    def __post_init__(self) -> None:
        self.word = np.repeat(np.arange(len(self.runs), dtype=np.int32), self.runs)
        self.many = np.flatnonzero(self.count > 1)  # the others have as many tables as customers

    def by_word(self, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Sums over the pairs of each word; of hot words, the given ones of all parts."""
        out = np.bincount(self.word, weights=x, minlength=len(self.runs))
        out[self.hot_word] = hot[self.hot_number]
        return out

    def start(self) -> np.ndarray:
        return np.minimum(self.count, 1)

    def packed(self, t: np.ndarray) -> bytes:
        return pack(t[self.many])

    def unpacked(self, data: bytes) -> np.ndarray:
        t = self.start().astype(np.float64)
        t[self.many] = unpack(data)
        return t


def word_probability(customers, tables, state: State, distinct: int) -> np.ndarray:
    """The word restaurant's predictive probability of dishes with so many customers and tables."""
    own = np.maximum(customers - state.words.discount * tables, 0)
    return (own + state.base(distinct)) / (state.words.strength + state.customers)


def _parent(state: State, distinct: int) -> Callable:
    d, new, s = state.words.discount, state.base(distinct), state.words.strength

    def probability(t: np.ndarray, rest: np.ndarray) -> np.ndarray:
        customers, tables, total = rest  # of the word, without those that the dish sent
        return (np.maximum(customers + t - d * np.maximum(tables, 1), 0) + new) / (s + total + t)

    return probability


def _bits(k: int, words: np.ndarray, contexts: np.ndarray | None = None) -> np.ndarray:
    """64 random bits of sweep k for pairs, or for words in the word restaurant."""
    with np.errstate(over="ignore"):
        x = _mixed(words + np.uint64(2 * k))
        return x if contexts is None else _mixed(x + _mixed(contexts) + np.uint64(1))


def sweep_part(
    part: Part, k: int, t: np.ndarray, t0: np.ndarray, tables: np.ndarray, state: State, distinct: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's tables (of pairs, and of words in the word restaurant) after sweep k, and the logs
    of seatings (see seat) of both levels. tables: of each context's restaurant before."""
    customers = part.by_word(t, state.hot_customers)
    many, word, context = part.many, part.word[part.many], part.context[part.many]
    left = customers[word] - t[many]
    rest = np.stack([left, np.minimum(t0[word], left), state.customers - t[many]])
    bits = _bits(k, part.words[word], part.contexts[context])
    level = state.contexts
    again, sits = seat(part.count[many], tables[context] - t[many], level.strength, level.discount, _parent(state, distinct), rest, bits, level.discounts)
    seated = part.start().astype(np.float64)
    seated[many] = again
    mine = np.bincount(part.word, weights=seated, minlength=len(part.runs))
    mine[part.hot_word] = 0  # seated by the driver
    in_words, word_sits = seat_words(mine, t0, _bits(k, part.words), state, distinct)
    return seated, in_words, sits, word_sits


def seat_words(customers: np.ndarray, before: np.ndarray, bits: np.ndarray, state: State, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of words in the word restaurant, whose parent holds all words alike."""
    alike = 1.0 / (distinct + 1)
    return seat(
        customers, state.tables - before, state.words.strength, state.words.discount, lambda t, _: alike, np.zeros((1, len(customers))), bits, state.words.discounts
    )


def predictive(part: Part, t: np.ndarray, t0: np.ndarray, totals: np.ndarray, tables: np.ndarray, state: State, distinct: int) -> np.ndarray:
    """Probability of each pair's word behind its previous word; totals, tables: customers and
    tables of the contexts' restaurants."""
    d, s = state.contexts.discount, state.contexts.strength
    words = word_probability(part.by_word(t, state.hot_customers), t0, state, distinct)
    own = np.maximum(part.count - d * t, 0)
    return (own + (s + d * tables[part.context]) * words[part.word]) / (s + totals[part.context])


# Chunks of texts.


def fold(id_: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds


def chunks(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    """A row per chunk of texts: its documents (ids, held, ends: where their tokens end), the
    tokens as places in the chunk's list of words, the words' hashes, the number of tokens, and
    the words that are at least a 4 * HOT_SHARE-th of them."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    ids_type = to_arrow_type(id_type)
    heavy = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("ends", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("hashes", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("heavy", heavy),
        ]
    )

    def row(chunk: int, ids: list, held_: list[bool], texts: list[np.ndarray], place: dict[bytes, int]) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        at = np.concatenate(texts)
        hashes = np.fromiter((xxh3_64_intdigest(w) for w in place), np.uint64, len(place))
        uses = np.bincount(at, minlength=len(place))
        much = np.flatnonzero(uses * 4 * HOT_SHARE >= len(at))
        listed = [{"hash": int(h), "n": int(n)} for h, n in zip(hashes[much].view(np.int64), uses[much], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([ids], pa.list_(ids_type)),
                pa.array([held_], pa.list_(pa.bool_())),
                pa.array([pack(np.cumsum([len(t) for t in texts]), "<i8")], pa.binary()),
                pa.array([pack(at)], pa.binary()),
                pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
                pa.array([len(at)], pa.int64()),
                pa.array([listed], to_arrow_type(heavy)),
            ],
            names=schema.names,
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, held_, texts, place, size = [], [], [], {END: 0}, 0
        for batch in batches:
            for i, h, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = raw.as_py()
                ids.append(i.as_py())
                held_.append(h.as_py())
                texts.append(np.array([*(place.setdefault(w, len(place)) for w in raw.lower().split()), 0], dtype=np.int32))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield row(number, ids, held_, texts, place)
                    number, ids, held_, texts, place, size = number + 1, [], [], [], {END: 0}, 0
        if ids:
            yield row(number, ids, held_, texts, place)

    return docs.select(
        F.col(id_col).alias("id"), held.alias("held"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw")
    ).mapInArrow(split, schema)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table of the shared folder, in buckets of key, so that a join by it leaves the
    table's rows where they are. The name goes at once, the files when the driver's JVM ends."""
    spark = df.sparkSession
    name = f"stripewise_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "none").format("parquet").saveAsTable(name)
    delete_at_end(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


@dataclass
class Pairs:
    """A chunk's distinct pairs in the order of (part, word's hash, previous word's hash)."""

    word: np.ndarray  # places in the chunk's list of words
    before: np.ndarray
    part: np.ndarray
    of_token: np.ndarray

    def words(self, a: int, b: int) -> np.ndarray:
        """Where words begin among the pairs a to b."""
        return a + np.flatnonzero(np.diff(self.word[a:b], prepend=-1))


def chunk_pairs(tokens: np.ndarray, hashes: np.ndarray, parts: int, hot: np.ndarray) -> Pairs:
    n = len(hashes)
    by_hash = np.argsort(hashes)
    rank = np.empty(n, np.int64)
    rank[by_hash] = np.arange(n)
    before = np.concatenate((np.zeros(1, np.int32), tokens[:-1]))
    key = _share(hashes, parts)[tokens]  # the part, then in place the order
    is_hot = np.flatnonzero(np.isin(hashes, hot)[tokens])
    key[is_hot] = _share(_mixed(hashes), parts)[before[is_hot]]
    for place in (tokens, before):
        key *= n
        key += rank[place]
    found, of_token = np.unique(key, return_inverse=True)
    return Pairs(by_hash[found // n % n].astype(np.int32), by_hash[found % n].astype(np.int32), (found // n // n).astype(np.int32), of_token)


BLOCK = "part int, chunk long, words binary, runs binary, contexts binary, context binary, count binary"


def blocks(kept: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """A row for each chunk and part: the chunk's pairs there, with their training counts. Chunks
    are taken bucket by bucket, one at a time, so that a task never holds several."""
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def deal(table: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        for chunk, held, ends, tokens, hashes in zip(*(table.column(i).to_pylist() for i in range(5)), strict=True):
            tokens, hashes = unpack(tokens), np.frombuffer(hashes, "<u8")
            sizes = np.diff(unpack(ends, "<i8"), prepend=0)
            pairs = chunk_pairs(tokens, hashes, parts, hot)
            train = np.repeat(~np.array(held, bool), sizes)
            count = np.bincount(pairs.of_token[train], minlength=len(pairs.word))
            edges = np.flatnonzero(np.diff(pairs.part, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                first = pairs.words(a, b)
                contexts, context = np.unique(hashes[pairs.before[a:b]], return_inverse=True)
                cells = [int(pairs.part[a]), chunk, hashes[pairs.word[first]].tobytes(), pack(np.diff(first, append=b))]
                cells += [contexts.astype("<u8").tobytes(), pack(context), pack(count[a:b])]
                for column, cell in zip(rows, cells, strict=True):
                    column.append(cell)
        pa.default_memory_pool().release_unused()  # a worker may keep much after large cells
        return pa.table([pa.array(x, t) for x, t in zip(rows, [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=names)

    return kept.select("chunk", "held", "ends", "tokens", "hashes").groupBy("chunk").applyInArrow(deal, BLOCK)


PART = (
    "part int, words binary, contexts binary, runs binary, context binary, count binary, hot binary, chunks array<long>, places array<binary>, "
    "train long, dishes long, known long, once array<long>, twice array<long>, hot_count array<long>"
)


def merged_part(table: pa.Table, hot: np.ndarray) -> pa.Table:
    """All chunks' pairs of a part as one row of PART; places: where each chunk's pairs are."""
    table = table.sort_by("chunk")
    col = lambda name: table[name].to_pylist()
    listed = [np.frombuffer(x, "<u8") for x in col("words")]
    words, word = np.unique(np.concatenate(listed), return_inverse=True)
    key = np.repeat(word, np.concatenate([unpack(x) for x in col("runs")]))
    listed = [np.frombuffer(x, "<u8") for x in col("contexts")]
    contexts, at = np.unique(np.concatenate(listed), return_inverse=True)
    starts = np.cumsum([0] + [len(x) for x in listed[:-1]])
    key *= len(contexts)
    key += np.concatenate([at[s + unpack(x)] for s, x in zip(starts, col("context"), strict=True)])
    count = np.concatenate([unpack(x) for x in col("count")])
    sizes = [int.from_bytes(x[:8], "little") for x in col("count")]
    found, place = np.unique(key, return_inverse=True)
    del key
    count = np.bincount(place, weights=count, minlength=len(found)).astype(np.int64)
    word, context = found // len(contexts), found % len(contexts)
    uses, dishes = (np.bincount(word, weights=x, minlength=len(words)) for x in (count, count > 0))
    numbers = np.searchsorted(hot, words)
    is_hot = (numbers < len(hot)) & (hot[np.minimum(numbers, len(hot) - 1)] == words) if len(hot) else np.zeros(len(words), bool)
    cold = ~is_hot
    hot_count, hot_dishes = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
    hot_count[numbers[is_hot]], hot_dishes[numbers[is_hot]] = uses[is_hot], dishes[is_hot]
    row = {
        "part": table["part"][0].as_py(),
        "words": words.astype("<u8").tobytes(),
        "contexts": contexts.astype("<u8").tobytes(),
        "runs": pack(np.bincount(word, minlength=len(words))),
        "context": pack(context),
        "count": pack(count),
        "hot": pack(np.concatenate([np.flatnonzero(is_hot), numbers[is_hot]])),
        "chunks": col("chunk"),
        "places": [pack(np.diff(x, prepend=0)) for x in np.split(place, np.cumsum(sizes)[:-1])],
        "train": int(count.sum()),
        "dishes": int((count > 0).sum()),
        "known": int((uses[cold] > 0).sum()),
        "once": [int((count == 1).sum()), int((dishes[cold] == 1).sum())],
        "twice": [int((count == 2).sum()), int((dishes[cold] == 2).sum())],
        "hot_count": np.concatenate([hot_count, hot_dishes]).tolist(),
    }
    pa.default_memory_pool().release_unused()
    return pa.Table.from_pylist([row], schema=_PART_ARROW)


PAIRS = ("words", "contexts", "runs", "context", "count", "hot")
_BINARY, _LONGS = pa.binary(), pa.list_(pa.int64())
_PART_ARROW = pa.schema(
    [("part", pa.int32()), *((x, _BINARY) for x in ("words", "contexts", "runs", "context", "count", "hot")), ("chunks", _LONGS), ("places", pa.list_(_BINARY))]
    + [("train", pa.int64()), ("dishes", pa.int64()), ("known", pa.int64()), ("once", _LONGS), ("twice", _LONGS), ("hot_count", _LONGS)]
)

#: What goes around: to a part (owner >= 0) from the range of contexts (or from the part itself,
#: range -1), or to a range of contexts (owner -1) from a part.
MESSAGE = "sweep int, owner int, range int, part int, a binary, b binary, stats array<double>"
_MESSAGE_ARROW = pa.schema(
    [(x, pa.int32()) for x in ("sweep", "owner", "range", "part")] + [("a", _BINARY), ("b", _BINARY), ("stats", pa.list_(pa.float64()))]
)


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_MESSAGE_ARROW.names, r, strict=True)) for r in rows], schema=_MESSAGE_ARROW)


def _part_of(row: dict) -> Part:
    hot = unpack(row["hot"])
    half = len(hot) // 2
    words, contexts = (np.frombuffer(row[x], "<u8") for x in ("words", "contexts"))
    return Part(words, contexts, unpack(row["runs"]), unpack(row["context"]), unpack(row["count"]), hot[:half], hot[half:])


def _slices(contexts: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes."""
    of = _share(contexts, parts)
    edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _asked(held: DataFrame, parts: int) -> DataFrame:
    """Each part's contexts with their customers and tables there, to their ranges."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, contexts, context, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                contexts, context, count = np.frombuffer(contexts, "<u8"), unpack(context), unpack(count)
                c = np.bincount(context, weights=count, minlength=len(contexts))
                t = np.bincount(context, weights=np.minimum(count, 1), minlength=len(contexts))
                for r, a, b in _slices(contexts, parts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r], pa.int32()),
                            pa.array([number], pa.int32()),
                            *(pa.array([x], pa.binary()) for x in (contexts[a:b].tobytes(), pack(c[a:b], "<i8"), pack(t[a:b], "<i8"))),
                        ],
                        names=["range", "part", "contexts", "c", "t"],
                    )

    return held.select("part", "contexts", "context", "count").mapInArrow(ask, "range int, part int, contexts binary, c binary, t binary")


def _gathered(table: pa.Table) -> pa.Table:
    """Of a range of contexts: answers to the parts that asked (customers, tables), the places of
    each part's contexts, kept for later sweeps, and the customers of all."""
    table = table.sort_by("part")
    listed = [np.frombuffer(x, "<u8") for x in table["contexts"].to_pylist()]
    found, place = np.unique(np.concatenate(listed), return_inverse=True)
    c, t = (
        np.bincount(place, weights=np.concatenate([unpack(x, "<i8") for x in table[n].to_pylist()]), minlength=len(found)) for n in ("c", "t")
    )
    number, rows = table["range"][0].as_py(), []
    for part, at in zip(table["part"].to_pylist(), np.split(place, np.cumsum([len(x) for x in listed])[:-1]), strict=True):
        rows.append((0, part, number, part, pack(c[at], "<i8"), pack(t[at], "<i8"), None))
        rows.append((-1, -1, number, part, pack(np.diff(at, prepend=0)), None, None))
    rows.append((-1, -1, number, -1, pack(c, "<i8"), None, None))
    return _messages(rows)


def _totalled(sweep: int, level: Level) -> Callable[[pa.Table], pa.Table]:
    """The same after a sweep, from the tables that the parts report."""

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        number = rows[0]["range"]
        customers = next(unpack(r["a"], "<i8") for r in rows if r["sweep"] == -1 and r["part"] == -1)
        places = {r["part"]: np.cumsum(unpack(r["a"])) for r in rows if r["sweep"] == -1 and r["part"] >= 0}
        tables = np.zeros(len(customers), np.int64)
        for r in rows:
            if r["sweep"] >= 0:
                tables[places[r["part"]]] += unpack(r["a"], "<i8")
        stats = openings(tables, customers, level).ravel().tolist()
        out = [(sweep, p, number, p, pack(customers[at], "<i8"), pack(tables[at], "<i8"), None) for p, at in places.items()]
        return _messages([*out, (sweep, -2, number, -1, None, None, stats)])

    return total


def _met(held: DataFrame, messages: DataFrame, buckets: int) -> DataFrame:
    """The parts, where they are, with the messages to them."""
    told = messages.where("owner >= 0").repartition(buckets, "owner").groupBy(F.col("owner").alias("part"))
    return held.join(told.agg(F.collect_list(F.struct("sweep", "range", "a", "b")).alias("told")), "part")


def _told(told: list[dict], part: Part, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the pairs and of the words in the word restaurant, and customers and tables of the
    contexts, after a sweep."""
    mine = sorted((m for m in told if m["sweep"] == sweep), key=lambda m: m["range"])
    own = [m for m in mine if m["range"] < 0]
    answers = [m for m in mine if m["range"] >= 0]
    customers, tables = (np.concatenate([unpack(m[x], "<i8") for m in answers]) for x in ("a", "b"))
    if own:
        return part.unpacked(own[0]["a"]), unpack(own[0]["b"]).astype(np.float64), customers, tables
    t = part.start().astype(np.float64)
    return t, np.minimum(np.bincount(part.word, weights=t, minlength=len(part.runs)), 1), customers, tables


def _swept(met: DataFrame, k: int, state: State, distinct: int, parts: int) -> DataFrame:
    """Sweep k: each part's new tables, to itself and to the ranges of its contexts; stats: the
    logs of seatings, customers and tables of its words, and customers of hot words."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, number = _part_of(row), row["part"]
                t, t0, _, tables = _told(row["told"], part, k - 1)
                t0[part.hot_word] = state.hot_tables[part.hot_number]
                t, in_words, sits, word_sits = sweep_part(part, k, t, t0, tables, state, distinct)
                customers = np.bincount(part.word, weights=t, minlength=len(part.runs))
                hot = np.zeros(len(state.hot_customers))
                hot[part.hot_number] = customers[part.hot_word]
                stats = [*sits, *word_sits, t.sum() - hot.sum(), in_words.sum(), *hot]
                rows = [(k, number, -1, number, part.packed(t), pack(in_words), [float(x) for x in stats])]
                up = np.bincount(part.context, weights=t, minlength=len(part.contexts))
                rows += [(k, -1, r, number, pack(up[a:b], "<i8"), None, None) for r, a, b in _slices(part.contexts, parts)]
                yield from _messages(rows).to_batches()
            pa.default_memory_pool().release_unused()

    return met.select("part", *PAIRS, "told").mapInArrow(sweep, MESSAGE)


def _summed(messages: DataFrame, owner: str) -> np.ndarray:
    """The stats of all parts or ranges, added up by place: a few thousand numbers."""
    each = messages.where("stats is not null").where(owner).select(F.posexplode("stats").alias("i", "x"))
    return np.array([r["x"] for r in each.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])


ANSWER = "chunk long, part int, p binary, uses binary"


def _answered(met: DataFrame, states: dict[int, State], distinct: int, hot_uses: np.ndarray) -> DataFrame:
    """For each chunk and part: log10 of the probability of each of the chunk's pairs, the mean
    over the states, and the training count of each of its words."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = _part_of(row)
                p = np.zeros(len(part.count))
                for k, state in states.items():
                    t, t0, customers, tables = _told(row["told"], part, k)
                    t0[part.hot_word] = state.hot_tables[part.hot_number]
                    p += predictive(part, t, t0, customers, tables, state, distinct)
                p = np.log10(p / len(states)).astype(np.float32)
                uses = part.by_word(part.count, hot_uses)
                for chunk, places in zip(row["chunks"], row["places"], strict=True):
                    at = np.cumsum(unpack(places))
                    words = part.word[at]
                    first = np.flatnonzero(np.diff(words, prepend=-1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk], pa.int64()),
                            pa.array([row["part"]], pa.int32()),
                            pa.array([pack(p[at], "<f4")], pa.binary()),
                            pa.array([pack(uses[words[first]], "<i8")], pa.binary()),
                        ],
                        names=["chunk", "part", "p", "uses"],
                    )

    return met.select("part", *PAIRS, "chunks", "places", "told").mapInArrow(answer, ANSWER)


def _scored(kept: DataFrame, answers: DataFrame, parts: int, hot: np.ndarray, n: int, distinct: int, buckets: int) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", kept.schema["ids"].dataType.elementType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ends, tokens, hashes, answered = (batch.column(i)[r].as_py() for i in (2, 3, 4, 5))
                tokens, hashes, ends = unpack(tokens), np.frombuffer(hashes, "<u8"), unpack(ends, "<i8")
                pairs = chunk_pairs(tokens, hashes, parts, hot)
                answered.sort(key=lambda a: a["part"])
                p = np.concatenate([unpack(a.pop("p"), "<f4") for a in answered])
                uses = np.zeros(len(hashes))
                edges = np.flatnonzero(np.diff(pairs.part, prepend=-1, append=-1))
                for a, b, told in zip(edges[:-1], edges[1:], answered, strict=True):
                    uses[pairs.word[pairs.words(a, b)]] = unpack(told["uses"], "<i8")
                base = np.log10((uses + 0.5) / (n + 0.5 * (distinct + 1)))
                first = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[r].values,
                        batch.column(1)[r].values,
                        pa.array(ends - first, pa.int64()),
                        pa.array(np.add.reduceat((uses > 0)[tokens].astype(np.int64), first), pa.int64()),
                        pa.array([n] * len(ends), pa.int64()),
                        pa.array(np.add.reduceat(base[tokens], first), pa.float64()),
                        pa.array(np.add.reduceat(p[pairs.of_token], first, dtype=np.float64), pa.float64()),
                    ],
                    names=schema.names,
                )
            pa.default_memory_pool().release_unused()

    told = answers.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "p", "uses")).alias("answered"))
    columns = ("ids", "held", "ends", "tokens", "hashes", "answered")
    return kept.select("chunk", *columns[:-1]).join(told, "chunk").select(*columns).mapInArrow(score, schema)


def _hot_words(kept: DataFrame, tokens: int) -> np.ndarray:
    """Hashes of words that are a good HOT_SHARE-th of all tokens, 5,500 at most.

    A word above that share has three quarters of its uses in chunks that list it as heavy."""
    uses = kept.select(F.explode("heavy").alias("w")).groupBy("w.hash").agg(F.sum("w.n").alias("n"))
    found = uses.where(F.col("n") * HOT_SHARE >= 0.75 * tokens).select("hash").collect()
    return np.sort(np.array([r["hash"] for r in found], np.int64).view(np.uint64))


def _discount(once: int, twice: int) -> float:
    return min(0.9, max(0.1, once / max(1, once + 2 * twice)))


def score_texts(
    docs: DataFrame, held: Column | None = None, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the documents where held is false (by default a fifth is held out, by a hash of
    the id) and scores all, whole. Words are ASCII-space separated, A-Z in lower case; every
    text ends in an end token. score: log10 of the text's probability, each token's being the
    mean over the sweeps past burn-in of its predictive probability behind the token before.
    base_score: the same of a unigram model with half a count added. perplexity() sums scores up.

    The driver holds the two levels' discounts and strengths, and a few numbers for each of the
    words that are dealt to all parts (5,500 at most). Parts hold about PART_TOKENS tokens of
    the corpus, whatever its size. Words and pairs are told apart by 64-bit hashes.

    Null and empty texts are an end token; null ids are trained on; repeated rows count as
    often as they occur; an empty table gives no rows; other columns are not carried, so their
    names cannot clash.
    """
    spark = docs.sparkSession
    held = (fold(F.col(id_col)) == HELD_OUT) if held is None else held
    files = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = bucketed(chunks(docs, held, id_col, text_col), "chunk", files)
    tokens = kept.agg(F.sum("n")).first()[0] or 0
    parts = 1 + tokens // PART_TOKENS
    buckets = min(parts, MOST_BUCKETS)
    hot = _hot_words(kept, tokens) if parts > 1 else np.zeros(0, np.uint64)

    grouped = blocks(kept, parts, hot).groupBy("part")
    held_pairs = bucketed(grouped.applyInArrow(lambda table: merged_part(table, hot), PART), "part", buckets)
    sums = held_pairs.agg(
        F.sum("train").alias("n"),
        F.sum("dishes").alias("dishes"),
        F.sum("known").alias("known"),
        *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("once", "twice") for i in (0, 1)],
    ).first()
    by_word = held_pairs.select(F.posexplode("hot_count").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    hot_sums = np.array([r["x"] for r in by_word], np.float64)
    hot_uses, hot_dishes = hot_sums[: len(hot)], hot_sums[len(hot) :]
    n = int(sums["n"] or 0)
    distinct = int(sums["known"] or 0) + int((hot_uses > 0).sum())

    gathered = stored(_asked(held_pairs, parts).groupBy("range").applyInArrow(_gathered, MESSAGE), "contexts")
    places, told = gathered.where("owner = -1"), {0: gathered.where("owner >= 0")}
    state = State(
        Level(_discount(sums["once0"] or 0, sums["twice0"] or 0), 1.0),
        Level(_discount(sums["once1"] or 0, sums["twice1"] or 0), 1.0),
        float(sums["dishes"] or 0),
        float(distinct),
        hot_dishes,
        np.minimum(hot_dishes, 1),
    )
    states: dict[int, State] = {}
    for k in range(1, sweeps + 1):
        seats = stored(_swept(_met(held_pairs, told[k - 1], buckets), k, state, distinct, parts), "seats")
        rows = places.unionByName(seats.where("owner = -1"))
        answers = stored(rows.groupBy("range").applyInArrow(_totalled(k, state.contexts), MESSAGE), "totals")
        told[k] = seats.where("owner >= 0").unionByName(answers.where("owner >= 0"))
        state = _next(state, _summed(seats, "owner >= 0"), _summed(answers, "owner = -2"), k, hot, distinct)
        states[k] = state
    last = {k: s for k, s in states.items() if k > BURN_IN} or states
    messages = None
    for k in last:
        messages = told[k] if messages is None else messages.unionByName(told[k])
    answers = _answered(_met(held_pairs, messages, buckets), last, distinct, hot_uses)
    return _scored(kept, answers, parts, hot, n, distinct, files)


def _next(state: State, seats: np.ndarray, opened: np.ndarray, k: int, hot: np.ndarray, distinct: int) -> State:
    """The state after sweep k, from the sums over the parts and over the ranges of contexts: hot
    words are seated here, then both levels' values are drawn."""
    if not len(seats):
        return state
    contexts, words = state.contexts, state.words
    sits, word_sits, (customers, tables), hot_customers = np.split(seats, np.cumsum([len(contexts.discounts), len(words.discounts), 2]))
    hot_tables, hot_sits = seat_words(hot_customers, state.hot_tables, _bits(k, hot), state, distinct)
    customers, tables = customers + hot_customers.sum(), tables + hot_tables.sum()
    own = openings(np.array([tables]), np.array([customers]), words)
    return State(
        contexts.drawn(sits, opened.reshape(len(contexts.discounts), -1), (SEED, k, 0)),
        words.drawn(word_sits + hot_sits, own, (SEED, k, 1)),
        float(customers),
        float(tables),
        hot_customers,
        hot_tables,
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and base_perplexity per token, over all scored texts."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity")
    )
