import csv
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_stripes import column

from stripewise.operators import evaluate, stripes, zonemap
from stripewise.plans import pruning
from stripewise.sources.striped import filtered, zone_option
from stripewise.streaming.append import append_indexes, windowed_counts

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def striped(spark, tmp_path_factory):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.concat(F.lit("s"), F.col("id") % 3).alias("t"))
    rows = stripes.assign_stripes(df, 64, "k", keep_tail=True)
    path = str(tmp_path_factory.mktemp("striped"))
    pruning.write_striped(rows, path)
    return rows, path


def test_pruned_scan(spark, striped, monkeypatch):
    rows, path = striped
    n = 1000 // 64
    zones = zonemap.build(rows.where(F.col("stripe_id") < n), "k")
    keys = spark.createDataFrame([(5,), (990,), (500,)], "value long")
    for most in (10_000, 0):
        monkeypatch.setattr(pruning, "MOST_LISTED", most)
        got = pruning.pruned_scan(spark, path, "k", [5, 990, 500], zonemap.candidates(zones, keys), n)
        assert sorted(r.k for r in got.collect()) == [5, 500, 990]
    monkeypatch.setattr(pruning, "MOST_LISTED", 10)
    plan = pruning.pruned_scan(spark, path, "k", [5], zonemap.candidates(zones, keys), n)._jdf.queryExecution().executedPlan().toString()
    assert "stripe_id" in plan.split("PushedFilters")[1]


def test_data_source_prunes(spark, striped):
    rows, path = striped
    zones = zone_option({"k": zonemap.build(rows, "k")})
    read = lambda c: filtered(spark, F.expr(c), path=path, zones=zones, stripes="16", columns="k long, v long, t string")
    assert read("true").count() == 1000 and read("true").rdd.getNumPartitions() == 16
    assert [tuple(r) for r in read("k = 130").collect()] == [(130, 4, "s1")]
    assert read("k = 130").rdd.getNumPartitions() == 1
    assert sorted(r.k for r in read("k in (1, 999)").collect()) == [1, 999]
    assert read("k = -5").count() == 0 and read("v = 3 and k < 20").count() == 3


def test_data_source_in_a_session_without_pushdown(spark, striped):
    """a session of another make does not push filters down."""
    rows, path = striped
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    zones = zone_option({"k": zonemap.build(rows, "k")})
    got = filtered(spark, F.expr("k = 130 AND v < 5"), path=path, zones=zones, stripes="16", columns="k long, v long, t string")
    assert [tuple(r) for r in got.collect()] == [(130, 4, "s1")] and got.rdd.getNumPartitions() == 1


def test_combined(spark):
    a, b = (spark.createDataFrame([(0, s) for s in x], "value long, stripe_id int") for x in ([1, 2, 3], [2, 3, 4]))
    assert sorted(r[0] for r in pruning.conjunction(a, b).collect()) == [2, 3]
    assert sorted(r[0] for r in pruning.disjunction(a, b).collect()) == [1, 2, 3, 4]


def test_workloads(spark):
    s = column(spark, [None if i % 10 == 0 else i % 37 for i in range(500)], k=50)
    held = {r.v for r in s.collect()} - {None}
    for case in ("positive_uniform", "positive_distinct", "positive_zipf"):
        got = evaluate.workload(s, "v", case, 100)[case].collect()
        assert sorted(r.i for r in got) == list(range(100)) and {r.value for r in got} <= held
    assert not {r.value for r in evaluate.negative(s, "v", 200).collect()} & held
    mixes = evaluate.workload(s, "v", "mixed", 100)
    assert list(mixes) == [f"mixed/{t / 10:.1f}" for t in range(11)]
    for t in (0, 3, 10):
        got = mixes[f"mixed/{t / 10:.1f}"].collect()
        assert len(got) == 100 and sum(r.value in held for r in got) == 10 * t
    zipf = [r.value for r in evaluate.positive_zipf(s, "v", 400).collect()]
    assert 0.4 < zipf.count(0) / 400 < 0.8
    with pytest.raises(ValueError):
        evaluate.workload(s, "v", "sideways", 1)


def test_report(spark, tmp_path):
    s = column(spark, [i % 23 for i in range(200)], k=20)
    results = evaluate.experiments(lambda _: (s, 10), ["v"], [20], [evaluate.zone_map_builder(), evaluate.xor_builder()], ["positive_distinct", "negative"], 50)
    assert results.count() == 4 and len(results.columns) == 23
    rows = {(r.index_structure, r.test_case): r for r in results.collect()}
    z = rows["ZoneMap", "negative"]
    assert z.num_lookups == 50 and z.num_true_negatives == 500 and z.index_size_bytes == 80 and z.bitmap_density > 0
    assert all(z[c.partition(":")[0]] > 0 for c in evaluate.REPORT if c.startswith("bitmap_"))
    evaluate.write_report(results, str(tmp_path / "r"))
    part = next((tmp_path / "r").glob("part-*.csv"))
    head, *lines = list(csv.reader(part.open()))
    assert head == evaluate.REPORT and len(lines) == 4
    got = {r.index_structure: r for r in evaluate.summary(results).collect()}
    assert got["PerStripeXor"].scan_rate_percent < 5
    only = evaluate.summary(results.where("test_case = 'positive_distinct'"))
    assert {r.scan_rate_percent for r in only.collect()} == {-1.0}


def test_command_line(spark, tmp_path, monkeypatch):
    from stripewise import __main__ as cli

    monkeypatch.setattr(evaluate, "usual_builders", lambda: [evaluate.zone_map_builder()])
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i % 9},s{i % 4}\n" for i in range(100)))
    for source in (["--input-csv", str(tmp_path / "a.csv"), "--columns-to-test", "x"], ["--generate-num-values", "100", "--num-unique-values", "9"]):
        args = cli.arguments([*source, "--num-rows-per-stripe-to-test", "10,20", "--num-lookups", "20", "--test-cases", "negative", "--sorting", "by_cardinality", "--output-csv", str(tmp_path / "out")])
        assert [r.num_stripes for r in cli.run(spark, args).orderBy("num_rows_per_stripe").collect()] == [10, 5]
    with pytest.raises(SystemExit):
        cli.arguments([])


def test_streaming(spark, tmp_path):
    s = column(spark, list(range(60)), k=10)
    s.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    append_indexes(stream, "v", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    zones = spark.read.parquet(str(tmp_path / "out/zones"))
    assert sorted((r.stripe_id, r.min, r.max) for r in zones.collect()) == [(i, 10 * i, 10 * i + 9) for i in range(6)]
    assert spark.read.parquet(str(tmp_path / "out/bloom")).select("stripe_id").distinct().count() == 6
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 03:00:00", "b")], "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "ev"))
    counts = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "kind")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50
    got = entry.entry(spark)
    assert got.columns == ["value", "stripes"] and got.count() > 0


def test_entry_without_the_training_operators(tmp_path):
    (tmp_path / "stripewise").symlink_to(tmp_path / "pkg")
    (tmp_path / "pkg").mkdir()
    for p in (ROOT / "stripewise").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "pkg" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'zone_map_build' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_files_follow_the_size_and_not_the_stripes(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS k", "id AS row_id", "cast(id div 10 as int) AS stripe_id")
    pruning.write_striped(rows, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 4
    found = spark.createDataFrame([(7, 0), (777, 77)], "value long, stripe_id int")
    scan = pruning.pruned_scan(spark, str(tmp_path / "t"), "k", [7, 777], found, 2000)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in scan.collect()) == [7, 777] and "PushedFilters" in plan and "In(stripe_id" in plan.replace("In(stripe_id,", "In(stripe_id")
