"""The queries over rolling windows of stride 1 against NumPy over every window of a small fixture."""

import numpy as np
import pytest

from plain import standardised, vwaps, window_features

from barlane.plans import oracle, queries
from barlane.sources import fixtures

SIZES = {1: 69, 2: 70, 3: 75, 8: 141}


@pytest.fixture
def arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    made = {s: (rng.uniform(1, 9, n).round(2), rng.integers(1, 50, n).astype(float)) for s, n in SIZES.items()}
    rows = [(s, t, float(c), float(v)) for s, (close, volume) in made.items() for t, (c, v) in enumerate(zip(close, volume, strict=True))]
    table = spark.createDataFrame(rows, "series_id long, time_step long, close double, volume double").repartition(3)
    monkeypatch.setattr(fixtures, "bars", lambda *_: table)
    return made


def starts():
    return [(s, a) for s, n in SIZES.items() for a in range(n - 69)]


def test_each_window_query_has_a_rolling_one():
    for name in oracle.OVER_WINDOWS:
        assert f"{name}_rolling" in queries.QUERIES
        assert oracle.STARTS_1 in oracle.SQL[f"{name}_rolling"] and oracle.STARTS_70 not in oracle.SQL[f"{name}_rolling"]


def test_features_of_every_window(spark, arrays):
    got = {(r["series_id"], r["start"], r["pos"]): r for r in queries.QUERIES["feature_pipeline_rolling"](spark, "").collect()}
    assert len(got) == 60 * len(starts())
    for s, a in starts():
        close, volume = (x[a : a + 60].tolist() for x in arrays[s])
        ret, delta, vol = window_features(close, volume)
        want = [close, volume, standardised(ret), standardised(delta), vol]
        have = [[got[s, a, i][c] for i in range(60)] for c in ("close", "volume", "log_ret", "vol_delta", "rolling_vol")]
        np.testing.assert_allclose(have, want, atol=2e-6)


def test_vwap_and_scaled_prices_of_every_window(spark, arrays):
    vwap = {(r["series_id"], r["start"], r["pos"]): r["vwap"] for r in queries.QUERIES["vwap_rolling"](spark, "").collect()}
    scaled = {(r["series_id"], r["start"], r["pos"]): r["close"] for r in queries.QUERIES["zscore_rolling"](spark, "").collect()}
    back = {(r["series_id"], r["start"], r["pos"]): r["close"] for r in queries.QUERIES["zscore_inverse_rolling"](spark, "").collect()}
    for s, a in starts():
        close, volume = (x[a : a + 60].tolist() for x in arrays[s])
        at = [(s, a, i) for i in range(60)]
        np.testing.assert_allclose([vwap[k] for k in at], vwaps([c + 3 for c in close], [v + 1 for v in volume]), atol=2e-4)
        np.testing.assert_allclose([scaled[k] for k in at], standardised(close), atol=2e-6)
        np.testing.assert_allclose([back[k] for k in at], close, atol=2e-6)


def test_every_bar_is_in_a_sample(spark, arrays):
    rows = queries.QUERIES["window_samples_long_rolling"](spark, "").collect()
    assert len(rows) == 70 * len(starts())
    assert {(r["series_id"], r["start"] + r["pos"]) for r in rows} == {(s, t) for s, n in SIZES.items() if n >= 70 for t in range(n)}
    assert all(r["close"] == arrays[r["series_id"]][0][r["start"] + r["pos"]] for r in rows)


def test_batches_and_shards_of_every_window(spark, arrays):
    rows = queries.QUERIES["batch_assign_rolling"](spark, "").collect()
    assert sorted((r["sample_idx"], r["series_id"], r["start"], r["batch_id"], r["in_batch"]) for r in rows) == [(i, s, a, i // 32, i % 32) for i, (s, a) in enumerate(starts())]
    stacked = {r["batch_id"]: (r["n"], r["first"], r["last"]) for r in queries.QUERIES["batch_stack_rolling"](spark, "").collect()}
    ends = [arrays[s][0][a + 69] for s, a in starts()]
    assert stacked == {b: (len(e), e[0], e[-1]) for b in range(-(-len(ends) // 32)) for e in [ends[32 * b : 32 * b + 32]]}
    assert sorted(r["sample_idx"] for r in queries.QUERIES["shard_round_robin_rolling"](spark, "").collect()) == list(range(1, len(ends), 3))


def test_rows_of_windows_are_many_tasks_work(spark, arrays):
    for name in ("zscore_rolling", "feature_pipeline_rolling", "window_samples_long_rolling", "standardisation_check_rolling"):
        plan = queries.QUERIES[name](spark, "")._jdf.queryExecution().executedPlan().toString()
        assert "arrays_zip" not in plan and "aggregate(" not in plan
        assert f"{4 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan


def test_rows_of_windows_come_from_one_row_a_part(spark, arrays):
    for name in ("vwap_pipeline_rolling", "vwap_rolling", "log_ret_rolling", "zscore_inverse_rolling", "rolling_vol_rolling", "vol_delta_rolling"):
        plan = queries.QUERIES[name](spark, "")._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan[: plan.index("MapInArrow")], plan[plan.index("MapInArrow") :]
        assert above.count("Generate explode") == 2
        assert "row_number" not in below and "__group" not in below  # bars are sorted in their arrays, windows aren't numbered
    plan = queries.QUERIES["window_samples_long_rolling"](spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "__group" not in plan


def test_bars_are_moved_under_their_own_names(spark, sf_dir):
    plan = fixtures.bars(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "hashpartitioning(series_id#" in moved


def test_rolling_vol_is_made_when_asked_for():
    from barlane.operators.blocks import Block

    block = Block(0, 0, np.arange(5), 60, np.linspace(1, 2, 64), np.ones(64))
    queries.basic.on_block(block)
    column = block.columns["rolling_vol"]
    assert callable(column._rows)
    assert column.rows.shape == (5, 60) and column.rows is column.rows


def test_rounding_takes_halves_from_zero():
    from barlane.operators.blocks import rounded

    x = np.array([0.5, -0.5, 2.5, -0.2, np.nan, 1e300, np.inf])
    got = rounded(x, 0)
    np.testing.assert_array_equal(got, [1, -1, 3, 0, np.nan, 1e300, np.inf])
    assert not np.signbit(got[3])
    np.testing.assert_array_equal(rounded(np.array([0.00005, 1234.56]), 4, 1e-7), [0.0001, 1234.56])


def test_bars_are_sorted_once(spark, sf_dir):
    for name in ("log_ret_rolling", "zscore_inverse_rolling"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number()") == 1


def test_places_from_steps_equal_counted_ones(spark, monkeypatch):
    from barlane.operators import windows

    monkeypatch.setattr(windows, "SPAN", 32)
    rows = [(s, t, 1 + t / 7, float(t)) for s, n in ((1, 69), (2, 70), (8, 141), (None, 80)) for t in range(n)]
    table = spark.createDataFrame(rows, "series_id long, time_step int, close double, volume double")
    for numbered in (False, True):
        counted, told = (sorted(tuple(r) for r in windows.blocks(table, numbered=numbered, dense=d).collect() if len(r["close"]) >= 70) for d in (False, True))
        assert counted == told and {r[0] for r in told} == {2, 8}


def test_samples_are_made_of_few_windows_at_a_time(spark, arrays):
    plan = queries.QUERIES["window_samples_long_rolling"](spark, "")._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce " in plan  # between the arrays of groups of windows and the rows


def test_rolling_vol_is_laid_out_once_but_for_first_rows():
    from barlane.operators.blocks import Block, pieces

    rng = np.random.default_rng(3)
    for n in (1, 5, 16, 37):
        block = Block(0, 0, np.arange(n), 60, rng.uniform(1, 9, n + 59), np.ones(n + 59))
        queries.basic.on_block(block)
        for name in ("log_ret", "rolling_vol", "close"):
            column = block.columns[name].mapped(lambda x: x * 2)
            laid = column.laid(block.starts, 60, 1)
            assert len(laid[0]) == n + 59
            values, offsets, leads = pieces(laid, n, 60, 16)
            _, by, heads, wide = laid
            for w, want in enumerate(column.dense(block.starts, 60)):
                piece, at = values[offsets[w // 16] : offsets[w // 16 + 1]], w % 16
                own = leads[w // 16] + (at * wide if len(heads) == n else 0)
                got = np.append(piece[own : own + wide], piece[at * by + wide : at * by + 60])
                np.testing.assert_array_equal(got, want)
