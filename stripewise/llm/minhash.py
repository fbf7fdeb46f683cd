"""Near-dedup: an inverted join of MinHash coordinates, then checks on the full shingle sets.

Every class of documents with equal shingle sets has a signature of K coordinates and is
posted under (coordinate, value) pairs. A pair of classes as similar as asked for agrees in M
coordinates or more but for a chance of MISS at most (see needed), so it meets under one of the K - M + 1
rarest coordinates of either: only those lists are merged, the longer ones being skipped. Whether
a candidate lies in a skipped list of its partner's is read off its signature, coordinate by
coordinate, which completes the count of collisions; pairs of M or more are retained.

A posting list is not paired with itself. Its most central class, the one whose values are
the most frequent, is its hub, and every class is held against its hubs. Those alike enough to
a hub form the hub's cluster; classes linked to the hub need no check among themselves, and
the others are held against the cluster in blocks of bounded size, which give a spanning forest
and not the pairs. The few classes unlike the hub of a list are paired with the list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripewise.llm.common import cut, small_batches, steady, stored
from stripewise.llm.components import components, meet

K = 48  # coordinates
MISS = 2e-6  # chance that a pair at the threshold is lost
NEAR = 16  # that a class must agree in with a hub to be in its cluster
BLOCK = 256  # classes of a cluster in a block
CHUNK_BYTES = 2 << 20
REMEMBERED = 100_000  # words whose hashes a Python worker keeps; then it forgets them all

_A = np.random.default_rng(5).integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_WORDS: dict[bytes, int] = {}


@cache
def needed(percent: int) -> int:
    """M: the most coordinates such that a pair just as similar agrees in fewer with a chance
    of MISS at most. K coordinates cannot hold that for percentages under 24."""
    p, below, m = percent / 100, 0.0, 0
    while m < K and (below := below + comb(K, m) * p**m * (1 - p) ** (K - m)) <= MISS:
        m += 1
    if not m:
        raise ValueError(f"{K} coordinates are too few to find pairs alike in {percent} percent")
    return m


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of frequent words are remembered in a bounded table."""
    import xxhash

    known, digest = _WORDS, xxhash.xxh3_64_intdigest
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: width words in a row, A-Z in lower
    case; a shorter text is one shingle, one without words none."""
    h = _word_hashes(text.lower().split())
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        x = np.full(n, len(h) if len(h) < width else width, dtype=np.uint64)
        for i in range(min(width, len(h))):
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x)


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """K coordinates for each of the sets, none of which is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), K), dtype=np.int32)
    with np.errstate(over="ignore"):
        for j in range(K):
            out[:, j] = np.minimum.reduceat(flat * _A[j], starts).astype(np.uint32).view(np.int32)
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _raw(docs: DataFrame, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"),
    )


def signatures(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """row (place in the scan), n (shingles), same (digest of the set), sig (null for none)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            first, size, sets = 0, 0, []
            for i in range(batch.num_rows):
                sets.append(shingle_set(texts[i].as_py(), width))
                size += 8 * len(sets[-1])
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    some = [s for s in sets if len(s)]
                    sigs = iter(signatures_of(some).tolist() if some else [])
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.slice(first, len(sets)),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                            pa.array([next(sigs) if len(s) else None for s in sets], pa.list_(pa.int32())),
                        ],
                        names=["row", "n", "same", "sig"],
                    )
                    first, size, sets = i + 1, 0, []

    return _raw(docs, text_col).mapInArrow(sign, "row long, n long, same binary, sig array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, hashes) of the wanted rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingle_set(t, width).view(np.int64) for t in part.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0] + [len(h) for h in made]), pa.int32())
                hashes = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made) if made else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), hashes], names=["node", "hashes"])

    rows = _raw(docs, text_col).join(wanted.select(F.col("node").alias("row")), "row", "left_semi")
    return rows.mapInArrow(make, "node long, hashes array<long>")


def _agree(a: str, b: str) -> Column:
    """Coordinates that two signatures have in common."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _alike(percent: int) -> Column:
    """100 * intersection >= percent * union, of the sets hashes_a and hashes_b."""
    a, b = F.size("hashes_a"), F.size("hashes_b")
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    near = 100 * F.least(a, b) >= percent * F.greatest(a, b)
    return F.when(near, 100 * both >= percent * (a + b - both)).otherwise(False)


def _with(pairs: DataFrame, payload: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of either node, as column_a and column_b."""
    for end in ("a", "b"):
        pairs = pairs.join(payload.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs


def _forest(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join, within two blocks, what the similar pairs across them join. Classes
    already linked to their hub count as one from the start."""
    a_sig, b_sig = np.stack(left["sig"].to_numpy()), np.stack(right["sig"].to_numpy())
    agree = np.zeros((len(left), len(right)), dtype=np.uint8)
    for j in range(K):
        agree += a_sig[:, j, None] == b_sig[None, :, j]
    na, nb = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    ids_a, ids_b = left["node"].to_numpy(), right["node"].to_numpy()
    may = (agree >= needed(percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (ids_a[:, None] != ids_b[None, :])
    may &= ~(left["linked"].to_numpy()[:, None] & right["linked"].to_numpy()[None, :])
    i, j = np.nonzero(may)
    order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
    sets_a, sets_b = ([np.asarray(x, np.int64).view(np.uint64) for x in side["hashes"]] for side in (left, right))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for ids, frame in ((ids_a, left), (ids_b, right)):
        for x in ids[frame["linked"].to_numpy()].tolist():
            top[x] = -1
    top[-1] = -1
    out = []
    for p, q in zip(i[order].tolist(), j[order].tolist(), strict=True):
        x, y = root(int(ids_a[p])), root(int(ids_b[q]))
        if x != y and similar(sets_a[p], sets_b[q], percent):
            top[max(x, y)] = min(x, y)
            out.append((int(ids_a[p]), int(ids_b[q])))
    return out


def links(docs: DataFrame, nodes: DataFrame, percent: int, width: int, text_col: str) -> DataFrame:
    """(a, b): similar pairs of nodes that join all that any similar pairs join."""
    m, n = needed(percent), nodes.count()
    posted = (K + 1 - m) * n  # at most
    posts = nodes.select("node", F.posexplode("sig").alias("j", "v"))
    # Counts and hubs are cut, so that the joins with them shuffle both sides and Spark can split
    # a long list.
    counted = cut(posts.groupBy("j", "v").agg(F.count("*").alias("df")).where("df > 1"), K * n // 2)
    shared = posts.join(counted, ["j", "v"])
    ranked = shared.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "j", "v"))).alias("p"), F.sum("df").alias("central")
    )
    room = F.lit(1 - m) + F.size("p")  # what single values leave of the prefix
    lists = cut(
        ranked.where(room > 0)
        .select("node", "central", F.explode(F.slice("p", F.lit(1), F.greatest(room, F.lit(1)))).alias("p"))
        .select("node", "central", "p.j", "p.v")
        .join(nodes.select("node", "n"), "node"),
        posted,
    )
    hubs = lists.groupBy("j", "v").agg(
        F.max(F.struct("central", (-F.col("node")).alias("least"))).alias("top"), F.count("*").alias("size")
    )
    hubs = cut(hubs.where("size > 1").select("j", "v", (-F.col("top.least")).alias("hub")), posted // 2)
    met = cut(lists.join(hubs, ["j", "v"]), posted)

    held = met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = cut(
        _with(held, nodes, "sig").select("a", "b", _agree("sig_a", "sig_b").alias("agree")).where(F.col("agree") >= NEAR),
        posted,
    )
    in_list = met.join(near.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("near")), ["node", "hub"], "left")
    in_list = in_list.withColumn("near", F.coalesce("near", F.col("node") == F.col("hub")))
    far = in_list.where("not near").select("j", "v", F.col("node").alias("a"), F.col("n").alias("n_a"))
    others = in_list.select("j", "v", F.col("node").alias("b"), F.col("n").alias("n_b"), "near")
    apart = (
        far.join(others, ["j", "v"])
        .where((F.col("a") < F.col("b")) | F.col("near") & (F.col("a") != F.col("b")))
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    apart = cut(_with(apart, nodes, "sig").where(_agree("sig_a", "sig_b") >= m).select("a", "b"))

    # The full sets of all classes that any check needs.
    tests = near.where(F.col("agree") >= m).select("a", "b").unionByName(apart)
    sizes = cut(near.groupBy("b").agg(F.count("*").alias("n")), n)
    held_near = near.count()
    clusters = meet(near, sizes.where("n > 1"), "b", held_near).select(F.col("b").alias("hub"), F.col("a").alias("node"))
    wanted = tests.select(F.explode(F.array("a", "b")).alias("node")).unionByName(clusters.select("node")).distinct()
    sets = stored(_sets(docs, wanted, width, text_col), "shingles")

    first = cut(_with(tests, sets, "hashes").where(_alike(percent)).select("a", "b"))

    # Within a cluster of more than BLOCK: those linked to the hub and the others in blocks of
    # their own, about BLOCK large, by a hash of the node, so that nobody numbers a cluster;
    # blocks of linked ones need no check against each other. A smaller cluster is one block.
    linked = first.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("linked"))
    members = clusters.join(linked, ["node", "hub"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    members = cut(members, held_near)
    parts = members.groupBy("hub").agg(F.count_if("linked").alias("l"), F.count_if(~F.col("linked")).alias("u"), F.count("*").alias("n"))
    of = lambda c, small: F.expr(f"cast(if(l + u <= {BLOCK}, {small}, ({c} + {BLOCK - 1}) div {BLOCK}) as int)")
    parts = cut(parts.where("u > 0").select("hub", "n", of("l", 0).alias("l"), of("u", 1).alias("u")), n)
    dealt = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("linked"), F.col("l")).otherwise(F.col("u")), F.lit(1))).cast("int")
    members = cut(
        meet(members, parts, "hub", held_near).select("hub", "node", "linked", F.when(F.col("linked") & (F.col("l") > 0), dealt).otherwise(F.col("l") + dealt).alias("block")),
        held_near,
    )
    units = (  # blocks below l are of linked ones
        parts.select("hub", "l", F.explode(F.sequence(F.lit(0), F.col("l") + F.col("u") - 1)).alias("y"))
        .where("y >= l")
        .select("hub", "y", F.explode(F.sequence(F.lit(0), F.col("y"))).alias("x"))
        .select("hub", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    )
    payload = nodes.select("node", "n", "sig").join(sets, "node")
    dealt = units.join(members, ["hub", "block"]).join(payload, "node").select("hub", "x", "y", "block", "node", "linked", "n", "sig", "hashes")

    def forest(unit: pd.DataFrame) -> pd.DataFrame:
        x, y = unit["x"].iloc[0], unit["y"].iloc[0]
        unit = unit.sort_values("node")
        pairs = _forest(unit[unit["block"] == x], unit[unit["block"] == y], percent)
        return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype="int64")

    inner = dealt.groupBy("hub", "x", "y").applyInPandas(forest, "a long, b long")
    return first.unionByName(inner)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, row, first.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    width-word shingles (A-Z in lower case; see shingle_set); component_id is the smallest
    doc_id reachable by links, kept says doc_id = component_id, and first is true for exactly
    one row of each component. Links are confirmed on full sets of 64-bit shingle hashes.

    Null and empty texts have no shingles, are linked with nothing and are kept; rows with
    equal sets are one class and linked; null ids are never the smallest unless all are null;
    an empty table gives no rows; other columns are not carried, so their names cannot clash.
    """
    docs = steady(docs)
    signed = cut(signatures(docs, width, text_col))
    n_rows = signed.count()
    nodes = cut(
        signed.where("n > 0").groupBy("same").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        n_rows,
    )
    joined = components(links(docs, nodes.select("node", "n", "sig"), percent, width, text_col))
    top = nodes.join(joined, "node", "left").select("same", F.coalesce("component", "node").alias("top"))
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"))
    rows = cut(
        signed.select("row", "n", "same")
        .join(top, "same", "left")
        .select("row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("top")).otherwise(-1 - F.col("row")).alias("top"))
        .join(ids, "row"),
        n_rows,
    )
    # Cut, so that the join below shuffles both sides and Spark can split a hot component.
    least = cut(
        rows.groupBy("top").agg(
            F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("first_row")
        ),
        n_rows,
    )
    return rows.join(least, "top").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "row",
        (F.col("row") == F.col("first_row")).alias("first"),
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates, all columns as they are."""
    docs = steady(docs)
    kept = near_duplicates(docs, width, percent, id_col, text_col).where("first").select(F.col("row").alias("__row"))
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(kept, "__row", "left_semi").drop("__row")
