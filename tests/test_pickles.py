"""Tables from folders of pickles, and pickles that do more than hold a table."""

import os
import pickle

import numpy as np
import pandas as pd
import pytest

from barlane.sources import io


def frame(series, n, **more):
    return pd.DataFrame({"series_id": np.full(n, series, np.int32), "time_step": np.arange(n, dtype=np.int16), "close": np.arange(n, dtype=np.float32) + series, "volume": 1.5} | more)


def test_a_folder_is_read_in_tasks(spark, tmp_path):
    for s in range(6):
        frame(s, 20 + s, other="x").to_pickle(tmp_path / f"part{s}.pkl")
    (tmp_path / "notes.txt").write_text("no table")
    got = io.read_pickles(spark, str(tmp_path), io.TRAIN)
    assert sorted((r["series_id"], r["time_step"], r["close"]) for r in got.collect()) == [(s, t, float(s + t)) for s in range(6) for t in range(20 + s)]
    assert io.read_train(spark, f"{tmp_path}/*.pkl").count() == sum(range(20, 26))
    assert io.read_train(spark, f"{tmp_path}/part3.pkl").schema == io.TRAIN
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("times", [
    pd.to_datetime(["2024-03-10 03:30", None]),
    pd.to_datetime(["2024-03-10 03:30", None]).tz_localize("UTC"),
    pd.to_datetime(["2024-03-10 04:30", None]).tz_localize("Europe/Berlin"),
    pd.Index(["2024-03-10 03:30:00", "no time"], dtype=object),
])
def test_times_and_optional_columns(spark, tmp_path, times):
    y = pd.DataFrame({"window_id": [1, 2], "time_step": [0, 1], "close": [2.0, np.nan], "event_datetime": times})
    y.to_pickle(path := str(tmp_path / "y.pkl"))
    rows = io.read_truth(spark, path).orderBy("window_id").collect()
    assert "token" not in rows[0].asDict() and rows[1]["close"] is None and rows[1]["event_datetime"] is None
    seconds = io.read_truth(spark, path).selectExpr("unix_seconds(event_datetime) s").where("s is not null").first()["s"]
    assert seconds == 1710041400


class Hostile:
    def __reduce__(self):
        return os.system, ("touch /tmp/hostile-pickle-ran",)


def test_a_hostile_pickle_is_refused(spark, tmp_path):
    frame(1, 5).to_pickle(tmp_path / "a.pkl")
    (tmp_path / "b.pkl").write_bytes(pickle.dumps(Hostile()))
    with pytest.raises(Exception, match="can't hold"):
        io.read_pickles(spark, str(tmp_path), io.TRAIN).collect()
    assert not os.path.exists("/tmp/hostile-pickle-ran")
    for content in (Hostile(), eval, pd.read_csv, np.load, getattr):
        with pytest.raises(pickle.UnpicklingError):
            io.unpickled(pickle.dumps(content))
    with pytest.raises(TypeError):
        io.unpickled(pickle.dumps([1, 2]))
