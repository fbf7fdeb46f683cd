"""What the findings of a review asked for, each by its number."""

import numpy as np
from pyspark.sql import functions as F
from test_stripes import column

from stripewise.functions.codecs import RleBitmap
from stripewise.operators import bitmaps, bloom, cuckoo, evaluate, truth, zonemap
from stripewise.plans.queries import QUERIES

D = "/root/testdata/sf0.001"
N = 300


def sets(spark):
    """Few ones, many, whole runs, the first and the last place, all places."""
    held = {1: [0, N - 1], 2: [7], 3: list(range(40, 90)), 4: list(range(N)), 5: list(range(0, N, 2))}
    return spark.createDataFrame(list(held.items()), "bitmap_id long, stripes array<int>"), {(b, s) for b, p in held.items() for s in p}


def test_f2_bitmaps_are_packed_from_their_ones(spark, monkeypatch):
    df, held = sets(spark)
    stored = bitmaps.packed_sets(df, N)
    assert {tuple(r) for r in bitmaps.unpacked_ones(stored).collect()} == held
    assert stored.where("bitmap_id = 2").select(F.length("payload")).first()[0] < N // 8
    monkeypatch.setattr(bitmaps, "from_stripes", None)  # the query makes no row of a bit
    assert QUERIES["bitmap_written_and_read"](spark, D).count() > 0


def test_f2_ones_of_any_bitmap():
    r = np.random.default_rng(2)
    for n in (0, 1, 17, 255, 256, 3000):
        for share in (0, 0.001, 0.1, 0.5, 1):
            for ones in (np.flatnonzero(r.random(n) < share), np.flatnonzero(np.repeat(r.random(n) < share, 30)[:n])):
                assert (RleBitmap.decode(RleBitmap.from_ones(ones, n).encode()).ones() == ones).all()


def test_f3_f4_every_pair_without_its_shuffle(spark):
    s = column(spark, [None if i % 10 == 0 else i * i % 37 for i in range(300)], k=20)
    held = {(r.v, r.stripe_id) for r in s.collect()}
    got = truth.contains_each(s, "v", 15).collect()
    values = {v for v, _ in held} - {None}
    assert sorted((r.value, r.stripe_id, r.found) for r in got) == sorted((v, i, (v, i) in held) for v in values for i in range(15))
    for name in ("truth_stripe_contains", "truth_stripe_contains_all"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")


def test_f6_f7_filters_of_one_length_answer_at_once(spark):
    """Blocks of one and of many filters, some of them alone with their length, texts as values."""
    few = [(f"t{i % 7 + 50 * s}", s) for s in range(90) for i in range(100)]
    many = [(f"u{i}", 90) for i in range(3000)]
    s = spark.createDataFrame(few + many, "v string, stripe_id int")
    keys = spark.createDataFrame([(f"{c}{i}",) for c in "tux" for i in range(0, 5000, 7)] + [(None,), ("t0",)], "value string")
    filters = bloom.build(s, "v", 10, md5=True)
    blocked = bloom.blocks(filters)
    assert sorted(len(r.stripes) for r in blocked.collect()) == [1, 90]
    got = sorted(tuple(r) for r in bloom.candidates_in(blocked, keys, 10, md5=True, block=500).collect())
    assert len(set(got)) == len(got)
    k = bloom.num_probes(10)
    h = keys.where("value is not null").distinct().select("value", *[c.alias(n) for n, c in zip("ab", bloom._hashes(F.col("value"), True))]).collect()
    one, two = (np.array([r[n] for r in h], np.int64) for n in "ab")
    want = set()
    for r in filters.groupBy("stripe_id", "m").agg(F.collect_list("word").alias("w"), F.collect_list("bits").alias("b")).collect():
        ok = bloom.contains(bloom._whole(np.array(r.w), np.array(r.b, np.int64), r.m), r.m, one, two, k)
        want |= {(x.value, r.stripe_id) for x, y in zip(h, ok) if y}
    assert set(got) == want and {(v, i) for v, i in few if (int(v[1:]) % 7 == 0 and int(v[1:]) < 5000)} <= want


def test_f8_f9_pairs_of_values_and_zones_are_not_shuffled(spark, monkeypatch):
    s = column(spark, [None if i < 20 or i % 10 == 0 else i * i % 37 for i in range(300)], k=20)
    zones, values = zonemap.build(s, "v"), truth.pairs(s, "v").select("value").distinct()
    want = sorted(tuple(r) for r in zonemap.probe(zones, values.crossJoin(zones.select("stripe_id"))).collect())
    for most in (100_000, 1):
        monkeypatch.setattr(zonemap, "MOST_SENT", most)
        assert sorted(tuple(r) for r in zonemap.probe_each(zones, values).collect()) == want
    for name in ("zone_map_probe", "zone_map_probe_all"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "HashJoin" not in plan and "MergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_f10_f11_an_index_is_built_once(spark, monkeypatch):
    s = column(spark, [i % 23 for i in range(100)], k=20)
    made, build = [], cuckoo.build
    monkeypatch.setattr(cuckoo, "build", lambda *a: made.append(a[3].scan_rate) or build(*a))
    names = [b(s, "v", 5).name for b in evaluate.usual_builders()[:2]]
    assert made == [0.001] and names[1] == f"PerStripeBloomComparableSize/{names[0]}"


def test_f5_f6_of_round_3_all_tests_of_an_index_are_asked_at_once(spark, monkeypatch):
    """Values are placed once for both hash indexes and an index is asked once for all tests; sizes
    and filters come from the same hashes, with the words that the bits' positions give."""
    s = column(spark, [None if i % 9 == 0 else i * i % 61 for i in range(400)], k=20)
    sets, asked = [], []
    value_stripes = truth.value_stripes
    monkeypatch.setattr(truth, "value_stripes", lambda *a: sets.append(1) or value_stripes(*a))
    built = [b(s, "v", 20) for b in evaluate.usual_builders()[:3]]
    assert len(sets) == 1 and [b.name[:6] for b in built] == ["Cuckoo", "PerStr", "Cuckoo"]
    counting = lambda b: lambda *a: evaluate.Built(b.name, lambda p: asked.append(b.name) or b.candidates(p), b.byte_size, b.compressed_size)
    rows = evaluate.experiments(lambda _: (s, 20), ["v"], [20], [counting(b) for b in built], ["positive_zipf", "negative"], 50).collect()
    assert asked == [b.name for b in built] and len(rows) == 6
    tests = {k: v for case in ("positive_zipf", "negative") for k, v in evaluate.workload(s, "v", case, 50).items()}
    for r in rows:
        b, keys = next(b for b in built if b.name == r.index_structure), tests[r.test_case]
        o = evaluate.outcome(b.candidates(keys), s, "v", keys, 20).first()
        assert (r.num_lookups, r.num_false_positives, r.num_true_negatives, 0) == tuple(o)


def test_f5_f6_of_round_3_filters_from_hashes(spark):
    s = column(spark, [None if i % 9 == 0 else i * i % 61 for i in range(400)], k=20)
    for bits in (1, 10, 30):
        words: dict = {}
        for r in bloom.positions(s, "v", bits, md5=True).collect():
            words[r.stripe_id, r.m, r.pos // 64] = words.get((r.stripe_id, r.m, r.pos // 64), 0) | 1 << r.pos % 64
        got = bloom.build(s, "v", bits, md5=True)
        assert {tuple(r)[:3]: r.bits % 2**64 for r in got.collect()} == words and got.count() == len(words)
        assert bloom.sizes_from(bloom.by_stripe(s, "v", md5=True), bits).first() == bloom.sizes(got).first()


def test_f1_to_f4_of_round_3_products_are_small_as_files(spark, tmp_path):
    """Rows in tiles take less than a byte in a file; by value, each stripe takes its four."""
    n = 60_000
    s = spark.range(n).select((F.col("id") % 40).alias("v"), F.col("id").cast("int").alias("stripe_id"))
    values = truth.pairs(s, "v").select("value").distinct()
    for name, product, yes in (("t", truth.contains_each(s, "v", n), "found"), ("z", zonemap.probe_each(zonemap.build(s, "v"), values), "maybe")):
        product.write.parquet(f"{tmp_path}/{name}")
        assert sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) < 40 * n
        got = spark.read.parquet(f"{tmp_path}/{name}")
        held = F.col("stripe_id") % 40 == F.col("value")
        assert got.distinct().count() == got.count() == 40 * n and got.where(F.col(yes) != held).count() == 0
