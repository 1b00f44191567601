import pytest

from barlane.operators import windows

SCHEMA = "series_id long, time_step long, close double, volume double"


def series(spark, sizes, gap=1):
    rows = [(s, t * gap, float(s * 1000 + t), float(t)) for s, n in sizes.items() for t in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(sizes, step):
    return {(s, a): [float(s * 1000 + t) for t in range(a, a + 70)] for s, n in sizes.items() for a in range(0, n - 69, step)}


SIZES = {1: 69, 2: 70, 3: 71, 4: 140, 5: 300}


@pytest.mark.parametrize(("rolling", "step"), [(True, 1), (True, 7), (False, None), (True, None), (False, 1)])
def test_windows_match_slices(spark, monkeypatch, rolling, step):
    monkeypatch.setattr(windows, "BLOCK", 75)
    monkeypatch.setattr(windows, "SPAN", 64)
    stride = step or (1 if rolling else 70)
    got = {(r["series_id"], r["start"]): r["x"]["close"] + r["y"] for r in windows.sample_windows(series(spark, SIZES), rolling, step).collect()}
    assert got == brute(SIZES, stride)


def test_positions_ignore_gaps_in_steps(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPAN", 64)
    got = windows.sample_windows(series(spark, {1: 72}, gap=50)).collect()
    assert sorted(r["start"] for r in got) == [0, 1, 2]


def test_counts(spark):
    df = series(spark, SIZES)
    count = lambda **k: windows.window_count(df, **k).first()["n_windows"]
    assert count() == 1 + 2 + 71 + 231
    assert count(rolling=False, step_size=None) == 1 + 1 + 2 + 4
    assert count(rolling=False) == 1 + 1 + 2 + 4
    assert windows.sample_windows(df, rolling=False).count() == 1 + 2 + 71 + 231  # the default stride wins


def test_empty_and_short(spark):
    assert windows.sample_windows(series(spark, {1: 5})).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert windows.sample_windows(empty).count() == 0
    assert windows.window_count(empty).first()["n_windows"] == 0


def test_required_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        windows.sample_windows(spark.createDataFrame([(1, 2, 3.0)], "series_id long, time_step long, close double"))
    with pytest.raises(ValueError):
        windows.sample_windows(series(spark, {1: 70}), window=70, input_len=50, horizon_len=10)


def test_index_batches_shards(spark):
    indexed = windows.sample_windows(series(spark, {2: 75, 5: 3, 9: 72})).select("series_id", "start", "sample_idx")
    rows = sorted((r["sample_idx"], r["series_id"], r["start"]) for r in indexed.collect())
    assert rows == [(i, *k) for i, k in enumerate([(2, s) for s in range(6)] + [(9, s) for s in range(3)])]
    assert sorted(r["batch_id"] for r in windows.batches(indexed, 4).collect()) == [0] * 4 + [1] * 4 + [2]
    parts = [{r["sample_idx"] for r in windows.shard(indexed, w, 2).collect()} for w in range(2)]
    assert parts == [{0, 2, 4, 6, 8}, {1, 3, 5, 7}]


@pytest.mark.parametrize(("rolling", "step", "most"), [(True, 1, 0), (True, 1, 3), (True, 1, 74), (True, 7, 13), (False, None, 4), (True, 1, 10**6)])
def test_cap_takes_the_first_windows(spark, monkeypatch, rolling, step, most):
    monkeypatch.setattr(windows, "BLOCK", 75)
    got = [(r["series_id"], r["start"]) for r in windows.sample_cap(series(spark, SIZES), most, rolling, step).collect()]
    assert sorted(got) == sorted(brute(SIZES, step or 70))[:most]


@pytest.mark.parametrize(("rolling", "step"), [(True, 1), (True, 7), (False, None)])
def test_numbers_follow_from_sizes(spark, monkeypatch, rolling, step):
    monkeypatch.setattr(windows, "BLOCK", 75)
    monkeypatch.setattr(windows, "SPAN", 64)
    got = [(r["sample_idx"], r["series_id"], r["start"]) for r in windows.window_arrays(series(spark, SIZES), rolling, step).collect()]
    assert sorted(got) == [(i, *k) for i, k in enumerate(sorted(brute(SIZES, step or 70)))]


def test_a_long_series_is_numbered_in_many_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.expr("id div 1000000").alias("series_id"), F.col("id").alias("time_step"), F.col("id").cast("double").alias("close"), F.lit(1.0).alias("volume"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = windows.sample_windows(rows).select(F.spark_partition_id().alias("p"), "sample_idx").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in spread) == 59_931 and len(spread) > 2


def test_first_batches(spark):
    indexed = windows.sample_windows(series(spark, {2: 80}))
    assert sorted(r["sample_idx"] for r in windows.first_batches(windows.batches(indexed, 4), 2).collect()) == list(range(8))
