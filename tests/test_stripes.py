import numpy as np
import pytest
from pyspark.sql import functions as F

from stripewise.operators import columns, stripes, truth
from stripewise.sources import tables


def column(spark, values, kind="bigint", k=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id bigint, v {kind}")
    return df if k is None else striped(df, k)


def striped(df, k):
    n = df.count() // k
    return df.withColumn("stripe_id", F.expr(f"cast(row_id div {k} as int)")).where(F.col("stripe_id") < n)


def test_row_ids_are_gapless_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = stripes.with_row_id(df, "k").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1000)) == [r.k for r in got]
    assert stripes.with_row_id(df.where("k < 0"), "k").count() == 0


def test_partial_stripe_is_dropped(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    got = stripes.assign_stripes(df, 3, "k").collect()
    assert sorted({r.stripe_id for r in got}) == [0, 1, 2] and len(got) == 9
    assert stripes.assign_stripes(df, 3, "k", keep_tail=True).count() == 10
    assert stripes.assign_stripes(df, 11, "k").count() == 0
    with pytest.raises(ValueError):
        stripes.assign_stripes(df, 0, "k")


def test_reorder(spark):
    rows = column(spark, [0, 1, 2, 3])
    moves = spark.createDataFrame(list(enumerate([2, 1, 3, 0])), "new_pos bigint, old_pos bigint")
    assert [r.v for r in stripes.reorder(rows, moves).orderBy("row_id").collect()] == [2, 1, 3, 0]


def test_sort_by_cardinality(spark):
    df = spark.createDataFrame([(0, 42, "US"), (1, 13, "CH"), (2, 1, "US"), (3, 42, "CH")], "u int, customer_id int, country string")
    order = stripes.sort_order(df, ["customer_id", "country"], "by_cardinality", "u")
    assert order == ["country", "customer_id", "u"]
    rows = stripes.with_row_id(df, *order)
    lines = columns.csv_lines(rows, ["customer_id", "country"]).orderBy("row_id").collect()
    assert [r.line for r in lines] == ["13,CH", "42,CH", "1,US", "42,US"]
    assert stripes.sort_order(df, [], "none", "u") == ["u"]
    with pytest.raises(ValueError):
        stripes.sort_order(df, [], "upwards", "u")


def test_dictionary(spark):
    df = spark.createDataFrame([(v,) for v in ["US", "CH", None, "US", "CH"]], "v string")
    codes = columns.dictionary(df, "v")
    assert {r.value: r.code for r in codes.collect()} == {None: 0, "CH": 1, "US": 2}
    back = columns.decode(columns.encode(df, "v", codes), codes)
    assert all(r.v == r.value for r in back.collect())


def test_stats(spark):
    df = column(spark, [1, 2, 2, 3, 10, None])
    s = columns.column_stats(df, "v").first()
    assert tuple(s) == (6, 1, 5, 1, 10)
    m = columns.column_moments(df, "v").first()
    assert (m["mean"], m.variance) == (3.6, 10.64) and abs(m.skewness - 1.3609) < 1e-3


def test_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,x,-5,\nNULL,2,7,\n3,NULL,,\n")
    df = tables.csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string", "d": "string"}  # a sign is no digit
    assert [r.c for r in df.collect()] == ["-5", "7", None] and [r.a for r in df.collect()] == [1, None, 3]
    (tmp_path / "b.csv").write_text("big,edge\n12345678901234567890,9223372036854775807\n1,2\n")
    big = tables.csv(spark, str(tmp_path / "b.csv"))
    assert dict(big.dtypes) == {"big": "string", "edge": "bigint"}  # nothing is lost to null
    assert [tuple(r) for r in big.collect()] == [("12345678901234567890", 9223372036854775807), ("1", 2)]
    assert tables.csv(spark, str(tmp_path / "a.csv"), ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="a, b, c, d"):
        tables.csv(spark, str(tmp_path / "a.csv"), ["e"])


def test_compressed_size(spark):
    size = lambda values, kind, k: columns.compressed_size(column(spark, values, kind, k), "v").first()[0]
    assert 20 < size([0, 1, 2, 3], "bigint", 4) < 30 and 50 < size([0, 1, 2, 3], "bigint", 1) < 60
    assert 20 < size(["DE", "US", "IT", "FR"], "string", 4) < 30 and 40 < size(["DE", "US", "IT", "FR"], "string", 1) < 50
    import datetime

    from stripewise.functions.codecs import compress

    packed = lambda x: len(compress(np.array(x).tobytes()))
    assert size([1.5, 2.25, None, 4.0], "double", 4) == packed([1.5, 2.25, 0, 4.0])
    assert size([2**53 + 1, None, 2, 3], "bigint", 4) == packed([2**53 + 1, 0, 2, 3])
    days = [datetime.date(2024, 1, d) for d in (1, 5, 9)]
    assert size(days, "date", 3) == packed(np.array([(d - datetime.date(1970, 1, 1)).days for d in days], "<i4"))
    times = [datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc) for d in (1, 5, 9)]
    assert size(times, "timestamp", 3) == packed([int(t.timestamp()) * 10**6 for t in times])


def test_sources(spark):
    df = tables.from_columns(spark, {"a": [1, None], "b": ["x", None]})
    assert dict(df.dtypes) == {"row_id": "bigint", "a": "bigint", "b": "string"}
    with pytest.raises(ValueError):
        tables.from_columns(spark, {"a": [1], "b": []})
    u = tables.uniform(spark, 2000, 50)
    assert u.count() == 2000 and u.select("value").distinct().count() == 50
    assert tables.uniform_name(100_000, 1000) == "uni_100K_val_1000_uniq"
    assert sorted(u.collect()) == sorted(tables.uniform(spark, 2000, 50).collect())


def test_truth(spark):
    s = column(spark, [1, None, 3, 4, None, 6], k=3)
    assert {r.value: r.stripes for r in truth.value_stripes(s, "v").collect()} == {1: [0], 3: [0], 4: [1], 6: [1]}
    probes = spark.createDataFrame([(1, 0), (1, 1), (9, 0)], "value bigint, stripe_id int")
    assert {(r.value, r.stripe_id): r.found for r in truth.stripe_contains(s, "v", probes).collect()} == {(1, 0): True, (1, 1): False, (9, 0): False}
    asked = spark.createDataFrame([(1,), (9,)], "value bigint")
    found = truth.qualifying(truth.pairs(s, "v").join(asked, "value", "left_semi"), asked)
    assert {r.value: r.stripes for r in found.collect()} == {1: [0], 9: []}
