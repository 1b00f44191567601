"""Choice of windows to forecast, and checks of what is handed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlane.sources.schemas import HORIZON


def preview(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` rows by the columns `order`; Spark keeps no more than these of each task."""
    return df.orderBy(*order).limit(most)


def distinct_windows(x_test: DataFrame, most: int | None = None) -> DataFrame:
    """window_id, each once; with `most` the smallest so many."""
    ids = x_test.select("window_id").distinct()
    return ids.orderBy("window_id").limit(most) if most is not None else ids


def first_windows(x_test: DataFrame, ordinal: str, most: int) -> DataFrame:
    """The `most` windows that come first by an input ordinal."""
    first = x_test.groupBy("window_id").agg(F.min(ordinal).alias("first"))
    return first.orderBy("first", "window_id").limit(most).select("window_id")


def _ids(df: DataFrame, must: Sequence[int] | DataFrame) -> DataFrame:
    return must.select("window_id").distinct() if isinstance(must, DataFrame) else df.sparkSession.createDataFrame([(int(i),) for i in must], "window_id long").distinct()


def select_windows(x_test: DataFrame, most: int, must: Sequence[int] | DataFrame) -> DataFrame:
    """The first `most` windows and, of those that must be in, the ones there are; each once."""
    there = _ids(x_test, must).join(x_test, "window_id", "left_semi")
    return distinct_windows(x_test, most).unionByName(there).distinct()


def missing_windows(x_test: DataFrame, must: Sequence[int] | DataFrame) -> DataFrame:
    """Windows that must be in but are not there."""
    return _ids(x_test, must).join(x_test, "window_id", "left_anti")


def only_windows(df: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """The rows of some windows: a list of ids becomes a predicate, a table a semi-join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("window_id"), "window_id", "left_semi")
    return df.where(F.col("window_id").isin([int(i) for i in ids]))


def steps_per_window(df: DataFrame) -> DataFrame:
    """Per window its rows, distinct steps, and smallest and largest step."""
    return df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("time_step").alias("n_steps"), F.min("time_step").alias("first_step"), F.max("time_step").alias("last_step"))


def violations(df: DataFrame, horizon: int = HORIZON, strict: bool = False) -> DataFrame:
    """Windows without `horizon` distinct steps; strict: also with other rows, or steps other than 0 .. horizon - 1."""
    s = steps_per_window(df)
    bad = F.col("n_steps") != horizon
    if strict:
        bad = bad | (F.col("n_rows") != horizon) | (F.col("first_step") != 0) | (F.col("last_step") != horizon - 1)
    return s.where(bad)


def validate(df: DataFrame, horizon: int = HORIZON, strict: bool = False) -> None:
    """ValueError, naming a few windows, if any is in violations()."""
    bad = violations(df, horizon, strict).orderBy("window_id").limit(5).collect()
    if bad:
        raise ValueError(f"windows without exactly {horizon} steps: {', '.join(str(r['window_id']) for r in bad)}")


def summary(df: DataFrame) -> DataFrame:
    """n_rows, n_windows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("window_id").alias("n_windows"))
