import json

import pandas as pd
import pytest

from barlane.operators import forecast, metrics, submission
from barlane.sources import io
from barlane.sources.schemas import narrow


def frame(spark, rows):
    return spark.createDataFrame(rows, "window_id long, time_step int, pred_close double")


def full(spark, windows=(1, 2)):
    return frame(spark, [(w, t, float(t)) for w in windows for t in range(10)])


def test_validation(spark):
    submission.validate(full(spark), strict=True)
    short = frame(spark, [(0, t, 1.2) for t in range(3)] + [(1, t, 0.9) for t in range(3)])
    with pytest.raises(ValueError, match="0, 1"):
        submission.validate(short)
    nine = full(spark).where("NOT (window_id = 2 AND time_step = 9)")
    assert [r["window_id"] for r in submission.violations(nine).collect()] == [2]
    more = full(spark).union(frame(spark, [(1, 9, 0.0)]))
    submission.validate(more)
    with pytest.raises(ValueError):
        submission.validate(more, strict=True)
    shifted = full(spark).selectExpr("window_id", "time_step + 1 AS time_step", "pred_close")
    submission.validate(shifted)
    with pytest.raises(ValueError):
        submission.validate(shifted, strict=True)


def test_selection(spark):
    x = full(spark, (5, 3, 8, 1))
    ids = lambda df: sorted(r["window_id"] for r in df.collect())
    assert ids(submission.distinct_windows(x, 2)) == [1, 3]
    assert ids(submission.select_windows(x, 2, [8, 99])) == [1, 3, 8]
    assert ids(submission.missing_windows(x, [8, 99])) == [99]
    assert ids(submission.only_windows(x, [5]).select("window_id").distinct()) == [5]
    ordered = spark.createDataFrame([(5, 2), (3, 0), (5, 1), (8, 9)], "window_id long, ordinal long")
    assert [r["window_id"] for r in submission.first_windows(ordered, "ordinal", 2).collect()] == [3, 5]
    assert submission.summary(x).first().asDict() == {"n_rows": 40, "n_windows": 4}


def test_tables_and_sidecar(spark, tmp_path):
    df = full(spark)
    for name in ("a.parquet", "b.pkl"):
        io.write_submission(df, str(tmp_path / name))
        assert io.read_table(spark, str(tmp_path / name), io.SUBMISSION).count() == 20
    train = pd.DataFrame({"series_id": [1], "time_step": [0], "close": [float("nan")], "volume": [2.0]})
    train.to_pickle(tmp_path / "t.pkl")
    assert io.read_train(spark, str(tmp_path / "t.pkl")).first()["close"] is None
    assert io.read_sidecar(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "info.json").write_text(json.dumps({"features": ["close"], "input_len": 60, "horizon_len": 10, "outputs": ["y"], "more": 1}, indent=1))
    assert io.read_sidecar(spark, str(tmp_path / "info.json"))["input_len"] == 60
    with pytest.warns(UserWarning):
        assert io.read_truth(spark, str(tmp_path / "no.parquet")) is None
    io.write_weights({"order": [1, 1, 0]}, str(tmp_path / "w" / "weights.json"))
    assert json.loads((tmp_path / "w" / "weights.json").read_text())["config"]["order"] == [1, 1, 0]
    assert io.literal_table(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    assert sum(1 for _ in io.stream_rows(df)) == 20 and io.to_arrow(df).num_rows == 20


def test_narrow(spark):
    kinds = dict(narrow(full(spark)).dtypes)
    assert kinds == {"window_id": "int", "time_step": "tinyint", "pred_close": "float"}
    assert narrow(spark.range(1)).columns == ["id"]


def test_forecasters(spark):
    close = [1.0, 2.0, 4.0, 5.0, 9.0]
    x = spark.createDataFrame([(7, t, c, 1.0) for t, c in enumerate(close)] + [(8, 0, 3.0, 1.0)], "window_id long, time_step int, close double, volume double")
    run = lambda m, w: [r["pred_close"] for r in forecast.generate_forecast(m.fit(x), x).where(f"window_id = {w}").orderBy("time_step").collect()]
    assert run(forecast.Persistence(), 7) == [9.0] * 10
    assert run(forecast.Drift(), 7)[:2] == [11.0, 13.0]
    d = [1.0, 2.0, 1.0, 4.0]
    phi = sum(a * b for a, b in zip(d, d[1:], strict=False)) / sum(a * a for a in d[:-1])
    assert run(forecast.AR1Diff(), 7)[1] == pytest.approx(9 + 4 * (phi + phi**2))
    for m in (forecast.Persistence(), forecast.Drift(), forecast.AR1Diff()):
        assert run(m, 8) == [3.0] * 10


def test_truth_with_bad_or_missing_times(spark, tmp_path):
    rows = [(1, t, float(t + 1), "2024-01-01 00:0%d:00" % t if t else "not a time", "tok") for t in range(10)]
    df = spark.createDataFrame(rows, "window_id long, time_step int, close double, event_datetime string, token string")
    df.write.parquet(path := str(tmp_path / "truth.parquet"))
    times = {r["time_step"]: r["event_datetime"] for r in io.read_truth(spark, path).collect()}
    assert times[0] is None and times[3].minute == 3
    df.drop("event_datetime", "token").write.parquet(bare := str(tmp_path / "bare.parquet"))
    y = io.read_truth(spark, bare)
    assert y.columns == ["window_id", "time_step", "close"]
    x = spark.createDataFrame([(1, t, 5.0, 1.0) for t in range(60)], "window_id long, time_step int, close double, volume double")
    row = metrics.evaluate_all_metrics(y, forecast.Persistence().predict(x), x).first()
    assert row["IC"] == row["IR"] == row["SharpeRatio"] == 0.0 and row["MSE"] > 0


def test_configuration_of_the_autoregression(tmp_path):
    model = forecast.AR1Diff(order=(1, 1, 0), maxiter=20)
    io.write_weights(model.cfg, str(tmp_path / "w.json"))
    assert json.loads((tmp_path / "w.json").read_text())["config"] == {"order": [1, 1, 0], "maxiter": 20, "horizon": 10}
    with pytest.raises(ValueError):
        forecast.AR1Diff(order=(2, 1, 0))
