"""The likelihood, the fit and the forecasts against a model's dense covariance matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlane.operators import arima, forecast
from barlane.plans import queries
from barlane.sources import fixtures

ORDERS = [(1, 1, 0), (2, 1, 1), (0, 1, 1), (1, 0, 2), (3, 2, 0), (0, 1, 0)]


def covariances(ar, ma, n):
    """Autocovariances 0..n-1 for e of variance 1, from a long moving average."""
    psi = np.zeros(6000)
    for j in range(len(psi)):
        psi[j] = (j == 0) + (ma[j - 1] if 1 <= j <= len(ma) else 0) + sum(a * psi[j - i - 1] for i, a in enumerate(ar) if j > i)
    return np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])


def dense(y, ar, ma, ahead=0):
    """(log likelihood, forecasts) from the whole covariance matrix."""
    n = len(y)
    g = covariances(ar, ma, n + ahead)
    at = lambda rows, cols: g[np.abs(np.subtract.outer(rows, cols))]
    seen, coming = np.arange(n), np.arange(n, n + ahead)
    c = at(seen, seen)
    w = np.linalg.solve(c, y)
    variance = y @ w / n
    return -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(c)[1]), at(coming, seen) @ w if ahead else None


def series(rows, n, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(rows, n + 1))
    return 100 + np.cumsum(e[:, 1:] + 0.6 * e[:, :-1], axis=1)


@pytest.mark.parametrize("order", ORDERS)
def test_likelihood_is_that_of_the_covariance_matrix(order):
    p, d, q = order
    y = np.diff(series(5, 40), d, axis=1) if d else series(5, 40) - 100
    free = np.random.default_rng(1).uniform(-0.8, 0.8, (5, p + q))
    ar, ma = arima.model(free, p)
    got = arima.kalman(y, ar, ma)
    for i in range(5):
        want, ahead = dense(y[i], ar[i], ma[i], 6)
        assert got.loglik[i] == pytest.approx(want, rel=1e-7)
        state = got.state[i]
        for h in range(6):
            assert state[0] == pytest.approx(ahead[h], rel=1e-6, abs=1e-6)
            state = got.transition[i] @ state


@pytest.mark.parametrize("order", [(1, 1, 0), (0, 1, 1), (2, 1, 0), (1, 1, 1), (2, 1, 1)])
def test_no_model_of_a_grid_is_likelier(order):
    p, _, q = order
    y = np.diff(series(6, 60, 3), axis=1)
    best = arima.kalman(y, *arima.fit(y, p, q, 100)).loglik
    axis = np.arctanh(np.linspace(-0.95, 0.95, 21 if p + q < 3 else 9) / arima.MOST)
    for point in np.stack(np.meshgrid(*[axis] * (p + q)), -1).reshape(-1, p + q):
        assert (arima.kalman(y, *arima.model(np.tile(point, (6, 1)), p)).loglik <= best + 0.02).all()


def test_iterations_are_bounded():
    y = np.diff(series(4, 60), axis=1)
    none, one, many = (arima.kalman(y, *arima.fit(y, 2, 1, n)).loglik for n in (0, 1, 50))
    white = arima.kalman(y, np.zeros((4, 2)), np.zeros((4, 1))).loglik
    np.testing.assert_allclose(none, white)
    assert (one >= none).all() and (many >= one - 1e-9).all() and (many > one).any()


@pytest.mark.parametrize("order", ORDERS)
def test_forecasts_add_up_what_was_differenced(order):
    p, d, q = order
    close = series(3, 50, 5)
    got = arima.forecast(close, order, 50, 4)
    y = np.diff(close, d, axis=1) if d else close - close.mean(1, keepdims=True)
    scale = np.sqrt((y * y).mean(1))[:, None]
    ar, ma = arima.fit(y / scale, p, q, 50)
    for i in range(3):
        ahead = dense(y[i], ar[i], ma[i], 4)[1]
        whole = close[i].tolist()
        for step in range(4):
            if d == 0:
                want = ahead[step] + close[i].mean()
            elif d == 1:
                want = whole[-1] + ahead[step]
            else:
                want = 2 * whole[-1] - whole[-2] + ahead[step]
            whole.append(want)
            assert got[i, step] == pytest.approx(want, rel=1e-6)


def test_short_and_constant_windows():
    assert arima.forecast(np.array([[5.0]]), (1, 1, 0), 9, 3).tolist() == [[5.0] * 3]
    assert arima.forecast(np.array([[5.0, 6.0]]), (2, 1, 1), 9, 2).tolist() == [[6.0] * 2]
    assert arima.forecast(np.full((2, 30), 7.0), (2, 1, 1), 9, 2).tolist() == [[7.0] * 2] * 2
    assert arima.forecast(np.array([[1.0]]), (0, 2, 0), 9, 2).shape == (1, 2)


def test_predict_takes_windows_of_any_length_and_missing_closes(spark):
    long, short = series(1, 60)[0].tolist(), series(1, 20, 9)[0].tolist()
    rows = [(1, i, c) for i, c in enumerate(long)] + [(2, i, c) for i, c in enumerate(short)] + [(2, 30, None), (2, 31, float("nan")), (3, 0, None)]
    x = spark.createDataFrame(rows, "window_id long, time_step int, close double").repartition(3)
    model = forecast.Arima((2, 1, 1), 30, 4)
    got = {(r["window_id"], r["time_step"]): r["pred_close"] for r in model.fit(x).predict(x).collect()}
    assert len(got) == 12 and all(got[3, h] is None for h in range(4))
    for w, values in ((1, long), (2, short)):
        want = arima.forecast(np.array([values]), (2, 1, 1), 30, 4)[0]
        assert [got[w, h] for h in range(4)] == pytest.approx(want.tolist())
    assert forecast.Arima((3, 1, 2)).cfg["order"] == [3, 1, 2]
    with pytest.raises(ValueError):
        forecast.Arima((1, -1, 0))


@pytest.mark.parametrize("order", [(1, 1, 0), (2, 1, 1)])
def test_query_has_the_likeliest_models_forecasts(spark, sf_dir, order):
    x = fixtures.tables(spark, sf_dir).x_test
    closes = {r["window_id"]: np.array(r["c"]) for r in x.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("time_step", "close")))["close"].alias("c")).collect()}
    got = {}
    for r in queries.QUERIES[f"forecast_arima_{order[0]}{order[1]}{order[2]}"](spark, sf_dir).collect():
        got[r["window_id"], r["time_step"]] = r["pred_close"]
    assert len(got) == 10 * len(closes)
    for w, c in closes.items():
        y = np.diff(c)
        fitted = arima.fit((y / np.sqrt((y * y).mean()))[None], order[0], order[2], 50)
        ahead = np.cumsum(dense(y, fitted[0][0], fitted[1][0], 10)[1])
        np.testing.assert_allclose([got[w, h] for h in range(10)], c[-1] + ahead, rtol=1e-4)
