import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stripewise.functions import codecs
from stripewise.operators import bitmaps


@pytest.fixture()
def bits(spark):
    rows = {0: "0000", 1: "1111", 2: "0001", 3: "0011", 4: "1010", 5: "1011"}
    return bitmaps.from_bits(spark.createDataFrame([(k, [int(c) for c in v]) for k, v in rows.items()], "bitmap_id int, bits array<int>"))


def test_measures(bits):
    got = {r.bitmap_id: (r.density, r.clustering) for r in bitmaps.measures(bits).collect()}
    assert got == {0: (0, 0), 1: (1, 4), 2: (0.25, 1), 3: (0.5, 2), 4: (0.5, 1), 5: (0.75, 1.5)}


def test_rank_and_select(spark):
    b = bitmaps.from_bits(spark.createDataFrame([(0, [0, 0, 0]), (1, [1, 1, 1]), (2, [1, 0, 1])], "bitmap_id int, bits array<int>"))
    ranks = {(r.bitmap_id, r.pos): r["rank"] for r in bitmaps.rank(b).collect()}
    assert [ranks[k, p] for k in range(3) for p in range(3)] == [0, 0, 0, 0, 1, 2, 0, 1, 1]
    assert {(r.bitmap_id, r.ith): r.pos for r in bitmaps.select(b, 1).collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 0): 0, (2, 1): 2}
    assert {(r.bitmap_id, r.ith): r.pos for r in bitmaps.select(b, 0).collect() if r.bitmap_id == 2} == {(2, 0): 1}


def test_concatenated_gaps_and_slices(spark):
    b = bitmaps.from_bits(spark.createDataFrame([(1, [0, 1]), (2, [1, 0])], "bitmap_id int, bits array<int>"))
    whole = sorted((r.global_pos, r.bit) for r in bitmaps.concatenated(b).collect())
    assert whole == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert sorted((r.bitmap_id, r.gap) for r in bitmaps.gaps(b).collect()) == [(1, 2), (2, 1)]
    assert sorted((r.bitmap_id, r.pos, r.bit) for r in bitmaps.extract(b, 1, 1).collect()) == [(1, 0, 1), (2, 0, 0)]
    assert bitmaps.bitpacked_size(3, 3) == 2
    assert {r.bitmap_id: r.roaring_bytes for r in bitmaps.roaring_size(b).collect()} == {1: 2, 2: 2}


@pytest.mark.parametrize(
    "bits",
    [np.zeros(0), *(f(n) for n in (1, 2, 100, 2000) for f in (np.zeros, np.ones)), *(np.isin(np.arange(4000), s) for s in ([2018], [2018, 2019], [2018, 2019, 3025], [2018, 2019, 3025, 3999])), np.concatenate([np.full(n, n % 2) for n in range(1, 89)])],
)
def test_rle_slices(bits):
    bits = np.asarray(bits, np.uint8)
    for rle in (codecs.RleBitmap(bits), codecs.RleBitmap.decode(codecs.RleBitmap(bits).encode())):
        for at in range(0, len(bits) + 1, max(1, len(bits) // 60)):
            for n in (0, 1, 7, 300, len(bits) - at):
                if at + n <= len(bits):
                    assert (rle.extract(at, n) == bits[at : at + n]).all()
        with pytest.raises(IndexError):
            rle.extract(0, len(bits) + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 200)), max_size=30))
def test_rle_round_trip(runs):
    bits = np.array([b for b, n in runs for _ in range(n)], np.uint8)
    assert (codecs.RleBitmap.decode(codecs.RleBitmap(bits).encode()).extract(0, len(bits)) == bits).all()
    assert (codecs.dense_decode(codecs.dense_encode(bits)) == bits).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 64), st.lists(st.integers(0, 2**64 - 1), max_size=70), st.data())
def test_bit_packing(width, values, data):
    v = np.array([x & ((1 << width) - 1) for x in values], np.uint64)
    packed = codecs.bit_pack(v, width)
    assert len(packed) == codecs.bytes_required(width * len(v))
    assert (codecs.bit_unpack(packed, width, len(v)) == v).all()
    if len(v):
        i = data.draw(st.integers(0, len(v) - 1))
        assert codecs.bit_unpack(packed, width, 1, i)[0] == v[i]


def test_widths_and_sizes():
    widths = [codecs.bit_width(x) for x in (0, 1, 2, 3, 4, 7, 255, 256, 2**32 - 1, 2**32, 2**64 - 1)]
    assert widths == [0, 1, 2, 2, 3, 3, 8, 9, 32, 33, 64]
    assert [codecs.bytes_required(b) for b in (0, 1, 8, 9, 257)] == [0, 1, 1, 2, 33]
    v = np.array([7, 2, 0, 1, 0, 4, 3, 0], np.uint64)
    assert len(codecs.bit_pack(v, codecs.max_bit_width(v))) == 3


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.binary(max_size=300))
def test_bytes(n, text):
    data = codecs.varint(n) + codecs.put_string(text)
    got, at = codecs.read_varint(data)
    assert got == n and codecs.read_string(data, at) == (text, len(data))
    assert codecs.uncompress(codecs.compress(text)) == text


def test_gap_list_and_numbers():
    assert codecs.sparse_gaps(np.array([0, 599]), 600).tolist() == [1, 0, 0, 89, 1]
    assert codecs.put_number(-1, "i8") == b"\xff" * 8 and len(codecs.put_number(1.5, "f4")) == 4
    with pytest.raises(ValueError):
        codecs.varint(-1)


def test_packed(bits):
    back = {(r.bitmap_id, r.pos): r.bit for r in bitmaps.unpacked(bitmaps.packed(bits)).collect()}
    assert back == {(r.bitmap_id, r.pos): r.bit for r in bits.collect()}


def test_sets_against_bits(spark):
    """The whole column from the ones alone, every bit looked at."""
    n, sets = 9, {1: [0, 1, 2, 7], 10: [8], 11: list(range(9)), 12: [0], 21: [3, 5, 6]}
    df = spark.createDataFrame(list(sets.items()), "bitmap_id long, stripes array<int>")
    bits = bitmaps.from_stripes(df, n)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    steps = [(r.bitmap_id, p, r["rank"]) for r in bitmaps.rank_steps(df, n).collect() for p in range(r.pos, r.pos + r.length)]
    assert sorted(steps) == rows(bitmaps.rank(bits).select("bitmap_id", "pos", "rank"))
    zeros = [(r.bitmap_id, r.ith + k, r.pos + k) for r in bitmaps.zero_runs(df, n).collect() for k in range(r.length)]
    assert sorted(zeros) == rows(bitmaps.select(bits, 0))
    assert rows(bitmaps.ones(df).select("bitmap_id", "ith", "pos")) == rows(bitmaps.select(bits, 1))
    assert rows(bitmaps.ones(df).select("bitmap_id", "pos", "gap")) == rows(bitmaps.gaps(bits))
    assert rows(bitmaps.set_measures(df, n)) == rows(bitmaps.measures(bits))
    assert rows(bitmaps.set_concatenated(df, n)) == rows(bitmaps.concatenated(bits).where("bit = 1").drop("bit"))
    assert rows(bitmaps.set_extract(df, n, 5, 6)) == rows(bitmaps.extract(bits, 5, 6))
    assert rows(bitmaps.set_extract(df, n, 12, 3)) == []
    assert rows(bitmaps.set_roaring_size(df)) == rows(bitmaps.roaring_size(bits))


def test_queries_take_every_customer(spark):
    from stripewise.plans.queries import QUERIES

    d = "/root/testdata/sf0.01"
    whole = QUERIES["value_stripes"](spark, d).count()
    for name in ("bitmap_rank_all", "bitmap_select_one_all", "bitmap_measures_all", "bitmap_global_all", "roaring_size_formula_all"):
        assert QUERIES[name](spark, d).select("bitmap_id").distinct().count() == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 400)), max_size=20))
def test_bitmaps_from_their_ones(runs):
    bits = np.array([b for b, n in runs for _ in range(n)], np.uint8)
    ones = np.flatnonzero(bits)
    rle = codecs.RleBitmap.from_ones(ones, len(bits))
    assert rle.encode() == codecs.RleBitmap(bits).encode()
    assert codecs.max_bit_width(rle.codes) <= 8  # a repeated bit is not part of its run's code
    for a, b in zip(codecs.runs_between(ones, len(bits)), codecs.runs_of(bits), strict=True):
        assert (a == b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200_000), min_size=1, max_size=300), st.integers(1, 3))
def test_roaring_containers(starts, step):
    ones = np.unique(np.array([s + i * step for s in starts for i in range(40)]))
    want = 0
    for chunk in np.unique(ones >> 16):
        low = ones[ones >> 16 == chunk] & 0xFFFF
        want += min(2 * len(low), 8192, 2 + 4 * (1 + int((np.diff(low) > 1).sum())))
    assert len(codecs.roaring_containers(ones)) == want


def test_column_sizes_and_measures(spark, monkeypatch):
    n, sets = 5, {1: [0, 1, 4], 2: [0, 3], 3: [4], 4: [0, 1, 2, 3, 4], 5: [0]}
    df = spark.createDataFrame(list(sets.items()), "bitmap_id long, stripes array<int>")
    whole = np.concatenate([np.isin(np.arange(n), s).astype(np.uint8) for s in sets.values()])
    m = bitmaps.global_measures(df, n).first()
    lengths, kinds = codecs.runs_of(whole)
    assert (m.bitmaps, m.density, m.clustering) == (5, whole.mean(), lengths[kinds == 1].mean())
    size = lambda x: len(codecs.compress(x))
    ones, rle = np.flatnonzero(whole), codecs.RleBitmap(whole).encode()
    got = bitmaps.codec_sizes(df, n).first()
    assert got.bitpacked_compressed_size == size(np.packbits(whole, bitorder="little").tobytes())
    assert (got.rle_size, got.rle_compressed_size) == (len(rle), size(rle))
    assert (got.roaring_size, got.roaring_compressed_size) == (len(codecs.roaring_containers(ones)), size(codecs.roaring_containers(ones)))
    assert got.roaring_individual_size == sum(r.roaring_bytes for r in bitmaps.set_roaring_size(df).collect())
    assert got.roaring_individual_compressed_size == sum(size(codecs.roaring_containers(np.array(s))) for s in sets.values())
    monkeypatch.setattr(bitmaps, "PART_BITS", 10)
    assert bitmaps.codec_sizes(df, n).first().roaring_size >= got.roaring_size
    none = df.where("bitmap_id < 0")
    assert bitmaps.codec_sizes(none, n).first().rle_size == 0 and bitmaps.global_measures(none, n).first().bitmaps == 0
