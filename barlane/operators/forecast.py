"""Forecasters. Built-in ones are closed forms on columns, or models fitted to many windows at once; others plug in as a
function of one window's pandas frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.functions.cluster import ship
from barlane.functions.columns import nan_to_null
from barlane.sources.schemas import HORIZON, SUBMISSION


class Forecaster(Protocol):
    """fit(train) may learn; predict(x_test) gives window_id, time_step 0 .. horizon - 1, pred_close."""

    def fit(self, train: DataFrame) -> Forecaster: ...

    def predict(self, x_test: DataFrame) -> DataFrame: ...


def _steps(df: DataFrame, horizon: int, value: Callable[[Column], Column]) -> DataFrame:
    h = F.col("time_step") + 1
    spread = df.withColumn("time_step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    return spread.select("window_id", "time_step", value(h).alias("pred_close"))


def _ends(x_test: DataFrame) -> DataFrame:
    return x_test.groupBy("window_id").agg(F.max_by("close", "time_step").alias("last"), F.min_by("close", "time_step").alias("first"), F.count(F.lit(1)).alias("n"))


class Persistence:
    """The last close, at every step."""

    def __init__(self, horizon: int = HORIZON) -> None:
        self.horizon = horizon

    def fit(self, train: DataFrame) -> Persistence:
        return self

    def predict(self, x_test: DataFrame) -> DataFrame:
        return _steps(_ends(x_test), self.horizon, lambda h: F.col("last"))


class Drift(Persistence):
    """The last close plus the mean change of the history, step by step."""

    def predict(self, x_test: DataFrame) -> DataFrame:
        slope = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
        return _steps(_ends(x_test), self.horizon, lambda h: F.col("last") + h * slope)


class AR1Diff(Persistence):
    """First-order autoregression of the changes, by conditional least squares: phi = sum d(t) d(t-1) / sum d(t-1)^2,
    taken as 0 where the divisor is. Step h is the last close plus the last change times phi + ... + phi^h.

    The order of the closed form is (1, 1, 0), and it needs no iterations: `maxiter` is taken and kept in `cfg` only. Arima has
    other orders, and this one by exact likelihood.
    """

    def __init__(self, order: tuple[int, int, int] = (1, 1, 0), maxiter: int = 50, horizon: int = HORIZON) -> None:
        if tuple(order) != (1, 1, 0):
            raise ValueError(f"order {order} has no closed form here; take Arima")
        super().__init__(horizon)
        self.order, self.maxiter = tuple(order), maxiter

    @property
    def cfg(self) -> dict:
        """What write_weights() stores."""
        return {"order": list(self.order), "maxiter": self.maxiter, "horizon": self.horizon}

    def predict(self, x_test: DataFrame) -> DataFrame:
        w = W.partitionBy("window_id").orderBy("time_step")
        d = x_test.withColumn("d", F.col("close") - F.lag("close").over(w)).withColumn("d1", F.lag("d").over(w))
        fit = d.groupBy("window_id").agg(
            F.max_by("close", "time_step").alias("last"),
            F.coalesce(F.max_by("d", "time_step"), F.lit(0.0)).alias("d"),
            F.sum(F.col("d") * F.col("d1")).alias("up"),
            F.sum(F.when(F.col("d").isNotNull(), F.col("d1") * F.col("d1"))).alias("down"),
        )
        fit = fit.withColumn("phi", F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(0.0))
        powers = lambda h: F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda a, k: a + F.pow("phi", k))
        return _steps(fit, self.horizon, lambda h: F.col("last") + F.col("d") * powers(h))


class Arima(Persistence):
    """An autoregressive integrated moving-average model of any order, fitted to each window by exact Gaussian likelihood.

    Windows go to tasks by window_id and are fitted side by side, as many as an Arrow batch holds of one length; no
    more than `maxiter` steps of the optimiser are taken. Rows without a close are left out of a window, and a window without
    any has null forecasts. Orders that are negative raise.
    """

    def __init__(self, order: tuple[int, int, int] = (1, 1, 0), maxiter: int = 50, horizon: int = HORIZON) -> None:
        if len(order) != 3 or min(order) < 0 or maxiter < 0:
            raise ValueError(f"no such order or number of iterations: {order}, {maxiter}")
        super().__init__(horizon)
        self.order, self.maxiter = tuple(order), maxiter

    @property
    def cfg(self) -> dict:
        """What write_weights() stores."""
        return {"order": list(self.order), "maxiter": self.maxiter, "horizon": self.horizon}

    def predict(self, x_test: DataFrame) -> DataFrame:
        order, maxiter, horizon = self.order, self.maxiter, self.horizon
        close = nan_to_null(F.col("close").cast("double"))
        bar = F.when(close.isNotNull(), F.struct("time_step", close.alias("close")))
        held = x_test.groupBy("window_id").agg(F.array_sort(F.collect_list(bar))["close"].alias("close"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from barlane.operators import arima

            for batch in batches:
                series = batch.column("close")
                sizes = series.value_lengths().to_numpy(zero_copy_only=False)
                flat, first = series.flatten().to_numpy(), sizes.cumsum() - sizes
                out = np.full((batch.num_rows, horizon), np.nan)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == size)
                    out[rows] = arima.forecast(flat[first[rows, None] + np.arange(size)], order, maxiter, horizon)
                steps = np.tile(np.arange(horizon, dtype=np.int32), batch.num_rows)
                ids = batch.column("window_id").take(pa.array(np.repeat(np.arange(batch.num_rows), horizon)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(steps), pa.array(out.ravel(), from_pandas=True)], ["window_id", "time_step", "pred_close"])

        ship(x_test.sparkSession)
        kind = held.schema["window_id"].dataType.simpleString()
        return held.mapInArrow(run, f"window_id {kind}, time_step int, pred_close double")


class PerWindow:
    """A model given as a function from one window's pandas frame to a frame of the submission's columns."""

    def __init__(self, predict_window: Callable, fit_model: Callable | None = None) -> None:
        self.predict_window, self.fit_model = predict_window, fit_model

    def fit(self, train: DataFrame) -> PerWindow:
        if self.fit_model is not None:
            self.fit_model(train)
        return self

    def predict(self, x_test: DataFrame) -> DataFrame:
        return x_test.groupBy("window_id").applyInPandas(self.predict_window, SUBMISSION)


def generate_forecast(model: Forecaster, x_test: DataFrame) -> DataFrame:
    """A model's submission for x_test, with the submission's types."""
    out = model.predict(x_test)
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SUBMISSION.fields))
