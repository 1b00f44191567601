"""Block features against the same transforms in long form, and datasets on disk against numpy."""

import numpy as np
import pytest
from plain import moments, standardised, vwaps, window_features
from pyspark.sql import functions as F

from barlane.operators import blocks, datasets, windows
from barlane.operators.features import BasicFeatures, Pipeline, Standardise, VwapFeatures

SCHEMA = "series_id long, time_step long, close double, volume double"
CHAINS = {
    "basic": BasicFeatures(),
    "vwap": VwapFeatures(0.0),
    "noisy": Pipeline([VwapFeatures(0.3, 7), BasicFeatures(), Standardise(["vwap", "log_ret"])]),
    "scaled": Standardise(["close", "volume"]),
    "all": Pipeline([BasicFeatures(), Standardise(["log_ret", "vol_delta", "rolling_vol"])]),
}


@pytest.fixture(scope="module")
def made():
    """Prices with constant stretches, nulls, zeros, and a large mean."""
    rng = np.random.default_rng(4)
    out = {}
    for s, n in {1: 70, 2: 69, 3: 230, 4: 160, 5: 90}.items():
        close, volume = rng.uniform(1, 9, n) + (1e6 if s == 4 else 0), rng.integers(0, 4, n).astype(float)
        if s == 3:
            close[40:130], volume[60:150] = 5.5, 3.0
        if s == 5:
            close[[3, 20, 21]], volume[[7]] = np.nan, np.nan
        out[s] = close, volume
    return out


@pytest.fixture(scope="module")
def bars(spark, made):
    rows = [(s, t, None if np.isnan(c) else float(c), None if np.isnan(v) else float(v)) for s, (close, volume) in made.items() for t, (c, v) in enumerate(zip(close, volume, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", CHAINS)
@pytest.mark.parametrize("inverse", [False, True])
def test_blocks_are_long_windows(bars, monkeypatch, name, inverse):
    monkeypatch.setattr(windows, "BLOCK", 75)
    monkeypatch.setattr(blocks, "BATCH", 20)
    chain = CHAINS[name]
    got = blocks.features(bars, chain, inverse=inverse)
    names = [f.name for f in got.schema.fields if f.dataType.simpleString() == "array<double>" and f.name != "y"]
    plain = chain.apply(windows.long_windows(bars).where("pos < 60"))
    plain = chain.invert(plain) if inverse else plain
    assert set(names) == set(plain.columns) - {"series_id", "block", "start", "pos"} - {c for c in plain.columns if c.endswith(("_mean", "_scale"))}
    key = ["series_id", "start", "pos"]
    have = {tuple(r[k] for k in key): r for r in blocks.long(got, names).collect()}
    want = plain.collect()
    assert len(have) == len(want)
    for r in want:
        h = have[tuple(r[k] for k in key)]
        for c in names:
            if r[c] is None or h[c] is None:
                assert r[c] is None and h[c] is None, (c, r, h)
            else:
                assert h[c] == pytest.approx(r[c], abs=2e-6, rel=1e-9), (c, r, h)


def test_scaling_twice_forgets_the_first_moments(bars):
    twice = Pipeline([Standardise(["close"]), Standardise(["close", "volume"])])
    assert blocks.features(bars, twice).count() == blocks.features(bars).count()
    with pytest.raises(RuntimeError):
        blocks.features(bars, twice, inverse=True)
    with pytest.raises(RuntimeError):
        twice.invert(twice.apply(windows.long_windows(bars)))


def test_moments_of_constant_and_large_windows():
    rng = np.random.default_rng(1)
    for values, first in ((np.full(90, 0.1), None), (np.full(90, 0.1), 0.0), (np.zeros(90), 0.0), (rng.normal(1e8, 1e-3, 90), None), (rng.normal(0, 1, 90), 5.0), (np.append(rng.normal(0, 1, 20), np.full(70, 0.3)), None)):
        starts = np.arange(31)
        column = blocks.Sliding(values, first)
        mean, spread = column.moments(starts, 60)
        for s, row in zip(starts, column.dense(starts, 60), strict=True):
            m, d = moments(row.tolist())
            assert mean[s] == pytest.approx(m, rel=1e-12, abs=1e-9) and spread[s] == pytest.approx(d, rel=1e-5, abs=1e-9)
            assert (len(set(row)) == 1) == (spread[s] == 0)


def test_no_shuffle_after_blocks_are_made(bars):
    plan = blocks.features(bars, CHAINS["all"])._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else plan
    assert "Exchange" not in above and "Window" not in above and "Sort" not in above


def brute(made):
    out = []
    for s, (close, volume) in sorted(made.items()):
        out += [(close[a : a + 60], volume[a : a + 60], close[a + 60 : a + 70]) for a in range(len(close) - 69)]
    return out


@pytest.mark.parametrize("workers", [1, 3])
def test_dataset_gives_features_and_targets_without_a_job(spark, bars, made, workers, monkeypatch):
    monkeypatch.setattr(datasets, "FILE_ROWS", 40)
    clean = bars.where("series_id < 5")
    data = datasets.FeatureDataset(clean, Pipeline([BasicFeatures(), Standardise(["log_ret", "vol_delta"])]), workers=workers)
    want = brute({s: x for s, x in made.items() if s < 5})
    assert len(data) == len(want) and data.columns == ["close", "volume", "log_ret", "vol_delta", "rolling_vol"]
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    for i in (0, 1, 2, 100, len(want) - 1, 57, 58):
        (x, y), (close, volume, target) = data[i], want[i]
        ret, delta, vol = window_features(close.tolist(), volume.tolist())
        np.testing.assert_allclose(x, np.array([close, volume, standardised(ret), standardised(delta), vol]).T, atol=1e-6)
        np.testing.assert_array_equal(y, target)
    for bad in (-1, len(want)):
        with pytest.raises(IndexError):
            data[bad]
    for w in range(workers):
        seen = list(data.each(w))
        assert [i for i, _, _ in seen] == list(range(w, len(want), workers))
        stacked = list(data.batches(32, w))
        assert sum(len(x) for x, _ in stacked) == len(seen) and all(len(x) == 32 for x, _ in stacked[:-1])
        np.testing.assert_array_equal(np.concatenate([y for _, y in stacked]), [y for _, _, y in seen])
    assert jobs() == before
    again = datasets.Samples(data.folder)
    assert len(again) == len(want) and (again[5][1] == want[5][2]).all()


def test_a_worker_reads_its_share(bars):
    data = datasets.WindowDataset(bars.where("series_id < 5"), workers=3)
    read = []
    for w in range(3):
        data.bytes_read = 0
        for _ in data.each(w):
            pass
        read.append(data.bytes_read)
    assert all(0.28 < r / sum(read) < 0.39 for r in read)


def test_random_access_reads_a_row_group(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("series_id"), F.col("id").alias("time_step"), F.col("id").cast("double").alias("close"), F.lit(1.0).alias("volume"))
    data = datasets.WindowDataset(rows)
    data[1500]
    one = data.bytes_read
    data.bytes_read = 0
    for _ in data.each():
        pass
    assert one < data.bytes_read / 5


def test_batches_stop_when_the_reader_does(bars):
    data = datasets.WindowDataset(bars.where("series_id < 5"), max_samples=50)
    assert len(data) == 50
    batches = data.batches(8, prefetch=1)
    next(batches)
    batches.close()
    assert [len(x) for x, _ in data.batches(25)] == [25, 25]


def test_lazy_pass_and_files(spark, bars, made, tmp_path):
    bars.where("series_id in (1, 4)").write.parquet(path := str(tmp_path / "train.parquet"))
    want = brute({s: made[s] for s in (1, 4)})
    got = list(datasets.lazy_features(path, VwapFeatures(0.0), spark=spark))
    assert len(got) == len(want)
    ends = {tuple(y): x for x, y in got}
    for close, volume, target in want:
        np.testing.assert_allclose(ends[tuple(target)][:, 2], vwaps((close + 3).tolist(), (volume + 1).tolist()), rtol=1e-9)
    shares = [list(datasets.lazy_windows(path, spark, w, 3)) for w in range(3)]
    assert sum(map(len, shares)) == len(want) and max(map(len, shares)) - min(map(len, shares)) <= 1
    assert len(datasets.WindowDataset(path, spark=spark, max_samples=2)) == 2
    with pytest.raises(ValueError):
        datasets.FeatureDataset(path, materialize=False, spark=spark)
