import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stripes import column

from stripewise.functions import hashing
from stripewise.functions.codecs import RleBitmap
from stripewise.operators import bloom, cuckoo, evaluate, truth, xor8, zonemap


def probes(spark, pairs):
    return spark.createDataFrame(pairs, "value bigint, stripe_id int")


@pytest.mark.parametrize(
    "values, k, yes, no",
    [
        ([1, 2, 3, 4], 2, [(1, 0), (2, 0), (3, 1), (4, 1)], [(0, 0), (3, 0), (2, 1), (5, 1)]),
        ([2, 1, 4, 3], 2, [(1, 0), (2, 0), (3, 1), (4, 1)], [(0, 0), (3, 0), (2, 1), (5, 1)]),
        ([1, 1, 2, 2], 2, [(1, 0), (2, 1)], [(0, 0), (2, 0), (1, 1), (3, 1)]),
        ([1, None, 3, 4, None, 6], 3, [(2, 0), (5, 1)], [(0, 0), (4, 0), (2, 1), (7, 1)]),
        ([None, None, 0, 4], 2, [(0, 1)], [(0, 0), (5, 1)]),
    ],
)
def test_zone_map(spark, values, k, yes, no):
    zones = zonemap.build(column(spark, values, k=k), "v")
    got = {(r.value, r.stripe_id): r.maybe for r in zonemap.probe(zones, probes(spark, yes + no)).collect()}
    assert got == dict.fromkeys(yes, True) | dict.fromkeys(no, False)
    found = {tuple(r) for r in zonemap.candidates(zones, probes(spark, yes + no)).collect()}
    assert set(yes) <= found and not set(no) & found
    assert zonemap.sizes(zones)[0] == 8 * len(values) // k


def test_zone_map_by_bins(spark, monkeypatch):
    s = column(spark, [(i * 37) % 500 for i in range(600)], k=20)
    zones, keys = zonemap.build(s, "v"), spark.range(-20, 600, 7).select(F.col("id").alias("value"))
    few = sorted(zonemap.candidates(zones, keys).collect())
    monkeypatch.setattr(zonemap, "MOST_SENT", 0)
    assert sorted(zonemap.candidates(zones, keys).collect()) == few


@pytest.mark.parametrize("make", [evaluate.zone_map_builder(), evaluate.bloom_builder(10), evaluate.xor_builder(), evaluate.cuckoo_builder(), evaluate.comparable_bloom_builder(evaluate.xor_builder())])
def test_no_index_misses_a_stripe(spark, make):
    s = column(spark, [None if i % 11 == 0 else (i * i) % 97 for i in range(400)], k=20)
    built = make(s, "v", 20)
    keys = truth.pairs(s, "v").select("value").unionByName(spark.range(200, 260).select(F.col("id").alias("value")))
    o = evaluate.outcome(built.candidates(keys), s, "v", keys, 20).first()
    assert o.num_false_negatives == 0 and built.byte_size > 0 and built.compressed_size > 0
    none = spark.createDataFrame([(None,)], "value bigint")
    assert built.candidates(none).count() == 0


def test_bloom_rules(spark):
    assert [bloom.num_probes(b) for b in (1, 10, 30, 60)] == [1, 6, 20, 30]
    s = column(spark, list(range(300)), k=100)
    size = bloom.sizes(bloom.build(s, "v", 10)).first()
    assert size.byte_size == 3 * 125
    small = bloom.comparable_bits(s, "v", 1)
    assert small == 1


def test_xor_filter():
    h = lambda a: np.array([int.from_bytes(__import__("hashlib").blake2b(str(int(x)).encode(), digest_size=8).digest(), "little") for x in a], np.uint64)
    data = xor8.build_filter(h(range(1000)))
    assert xor8.filter_contains(data, h(range(1000))).all()
    assert xor8.filter_contains(data, h(range(1000, 2000))).mean() < 0.01
    assert len(data) < 1.4 * 1000 + 100
    assert len(xor8.build_filter(np.zeros(0, np.uint64))) > 8


@pytest.mark.parametrize("n, slots, load, want", [(10, 2, None, 6), (10, 4, None, 3), (10, 8, None, 2), (10, 1, 0.5, 20), (1, 8, 0.99, 1), (0, 1, 0.5, 0)])
def test_min_buckets(n, slots, load, want):
    assert cuckoo.min_buckets(n, slots, load) == want


def test_unsupported(spark):
    s = column(spark, [1, 2], k=1)
    with pytest.raises(NotImplementedError):
        cuckoo.build(s, "v", 2, cuckoo.Config(algorithm=cuckoo.Algorithm.MATCHING))
    with pytest.raises(ValueError):
        cuckoo.build(s, "v", 2, cuckoo.Config(slots=3))
    with pytest.raises(ValueError):
        cuckoo.min_buckets(1, 3)


@pytest.mark.parametrize("skewed", [False, True])
def test_kicking(skewed):
    rng = np.random.default_rng(1)
    n = 30_000
    h1, h2 = rng.integers(0, 2**62, n), rng.integers(0, 2**62, n)
    buckets = cuckoo.min_buckets(n, 2)
    for _ in range(10):
        first, second = h1 % buckets, h2 % buckets
        rows = cuckoo.distribute(first, second, buckets, 2, skewed)
        if rows is not None:
            break
        buckets += 1
    at = {v: b for b, r in enumerate(rows) for v in r}
    assert len(at) == n and all(at[v] in (first[v], second[v]) for v in at) and max(map(len, rows)) <= 2
    home = np.mean([at[v] == first[v] for v in at])
    assert home > (0.6 if skewed else 0)
    assert rows == cuckoo.distribute(first, second, buckets, 2, skewed)


@pytest.mark.parametrize("num_values", [1, 30, 300])
@pytest.mark.parametrize("prefix", [False, True])
def test_cuckoo_index(spark, num_values, prefix):
    s = column(spark, [i // (300 // num_values) for i in range(300)], k=3)
    config = cuckoo.Config(slots=2, load_factor=0.84, scan_rate=0.1, algorithm=cuckoo.Algorithm.KICKING, prefix_bits=prefix)
    index = cuckoo.build(s, "v", 100, config)
    want = {r.value: r.stripes for r in truth.value_stripes(s, "v").collect()}
    assert {r.value: r.stripes for r in cuckoo.lookup(index, truth.pairs(s, "v")).collect()} == want
    keys = spark.range(num_values + 1, num_values + 10_001).select(F.col("id").alias("value"))
    read = cuckoo.candidates(index, keys).count() / (10_000 * 100)
    assert read <= 0.101 and cuckoo.same_length(index.slots).count() == 0
    assert cuckoo.active_slots(index) == num_values
    assert config.name == "CuckooTable:0:0.84:0.1"


def test_last_row_is_dropped(spark):
    index = cuckoo.build(column(spark, [1, 2, 3, 4], k=3), "v", 1)
    assert cuckoo.active_slots(index) == 3 and index.num_stripes == 1


def test_several_shards(spark):
    s = column(spark, list(range(2000)), k=100)
    index = cuckoo.build(s, "v", 20, shard_values=300)
    assert index.num_shards == 7
    assert {r.value: r.stripes for r in cuckoo.lookup(index, truth.pairs(s, "v")).collect()} == {i: [i // 100] for i in range(2000)}


def test_fingerprints(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(0b1111 << 60), n) for n in range(4)] + [(signed(0b1011 << 60), n) for n in range(4)], "fp bigint, n int")
    got = [r[0] for r in df.select(hashing.prefix(F.col("fp"), F.col("n"))).collect()]
    assert got == [0, 1, 0b11, 0b111, 0, 1, 0b10, 0b101]
    one = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (0b1, 0b11, 0b111)]).alias("f"))
    assert one.select(hashing.collision_free_bits(F.col("f")), hashing.collision_free_bits(F.col("f"), True)).first()[:] == (3, 63)
    ends = spark.createDataFrame([(-1, 0), (-1, 63), (-1, 64), (5, 64)], "fp bigint, n int")
    assert [r[0] for r in ends.select(hashing.suffix(F.col("fp"), F.col("n"))).collect()] == [0, 2**63 - 1, -1, 5]


def test_rle_of_a_bucket_map():
    bits = np.array([0, 1] * 400 + [1] * 100, np.uint8)
    assert (RleBitmap.decode(RleBitmap(bits).encode()).extract(0, 900) == bits).all()


@pytest.mark.parametrize("kind", ["date", "timestamp", "string"])
def test_zone_map_of_other_types_by_bins(spark, monkeypatch, kind):
    s = column(spark, [(i * 37) % 500 for i in range(600)], k=20)
    how = "concat(array('a', 'b', 'é', '😀')[v % 4], v)" if kind == "string" else f"cast(date_add(DATE'2024-01-01', cast(v as int)) as {kind})"
    s = s.withColumn("v", F.expr(how))
    zones, keys = zonemap.build(s, "v"), s.select(F.col("v").alias("value")).distinct()
    few = sorted(zonemap.candidates(zones, keys).collect())
    monkeypatch.setattr(zonemap, "MOST_SENT", 0)
    assert few and sorted(zonemap.candidates(zones, keys).collect()) == few


def test_bloom_in_blocks(spark):
    """Blocks of probes, bits looked at one by one."""
    s = column(spark, [(i * 37) % 211 for i in range(400)], k=50)
    keys = spark.range(-20, 400).select(F.col("id").alias("value"))
    filters = bloom.build(s, "v", 5, md5=True)
    got = {tuple(r) for r in bloom.candidates(filters, keys, 5, md5=True, block=37).collect()}
    set_ = {(r.stripe_id, r.pos): r.m for r in bloom.positions(s, "v", 5, md5=True).collect()}
    sizes = {stripe: m for (stripe, _), m in set_.items()}
    h = lambda seed, v: int(__import__("hashlib").md5(f"{seed}:{v}".encode()).hexdigest()[:15], 16) % 2**31
    want = {(v, x) for v in range(-20, 400) for x, m in sizes.items() if all((x, (h(1, v) + i * h(2, v)) % m) in set_ for i in range(bloom.num_probes(5)))}
    assert got == want


def test_saved_index(spark, tmp_path):
    s = column(spark, [i % 97 for i in range(400)], k=20)
    index = cuckoo.build(s, "v", 20, cuckoo.Config(slots=4, prefix_bits=True), shard_values=50)
    cuckoo.save(index, str(tmp_path / "i"))
    back = cuckoo.load(spark, str(tmp_path / "i"))
    assert (back.num_shards, back.num_stripes, back.config) == (index.num_shards, index.num_stripes, index.config)
    keys = spark.range(-5, 120).select(F.col("id").alias("value")).unionByName(spark.createDataFrame([(None,)], "value long"))
    rows = lambda i: sorted(((r.value, r.stripes) for r in cuckoo.lookup(i, keys).collect()), key=repr)
    assert rows(back) == rows(index) and len(rows(back)) == 126
    fill = {r.held: r.buckets for r in cuckoo.stats(index).collect()}
    buckets = index.shards.agg(F.sum("buckets")).first()[0]
    assert sum(fill.values()) == buckets and sum(k * n for k, n in fill.items()) == 97


def test_zone_stats(spark):
    zones = zonemap.build(column(spark, [0, 10, None, None, 4, 5], k=2), "v")
    got = zonemap.stats(zones, (0, 10)).first()
    assert (got.zones, got.empty_zones) == (3, 1) and abs(got.mean_width - (1 + 0.1) / 2) < 1e-12


def test_blocks_count_every_bucket(spark):
    index = cuckoo.build(column(spark, list(range(200)), k=20), "v", 10)
    rows = cuckoo.blocks(index).collect()
    assert sum(r.buckets for r in rows) == index.shards.agg(F.sum("buckets")).first()[0] and sum(r.fingerprints for r in rows) == 200
    assert [r.buckets for r in rows] == sorted((r.buckets for r in rows), reverse=True)
    assert [r.fingerprints for r in rows if r.num_bits == 0] == [0]


def test_phases():
    from stripewise.functions.profiling import Phases

    phases = Phases()
    for _ in range(3):
        with phases.phase("a"):
            pass
    with pytest.raises(KeyError), phases.phase("b"):
        raise KeyError
    assert phases.times == {"a": 3, "b": 1} and all(x >= 0 for x in phases.seconds.values())
    assert [x.split(":")[0] for x in phases.lines()] == ["a", "b"]
    phases.reset()
    assert not phases.lines()
