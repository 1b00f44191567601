"""One-step returns of truth and prediction over the true price before each step."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.functions.columns import nan_to_null, simple_return
from barlane.sources.schemas import INPUT_LEN

KEYS = ["window_id", "time_step"]
MODES = ("literal", "contiguous")


class Returns(NamedTuple):
    true: DataFrame
    pred: DataFrame


def previous_prices(y_true: DataFrame, x_test: DataFrame, mode: str = "literal", input_len: int = INPUT_LEN) -> DataFrame:
    """window_id, time_step, prev_price.

    `literal` orders history and truth together by their own steps, history first on equal steps; where both count
    from 0, steps 1..9 then have two previous prices. `contiguous` puts truth after history, so every step has one.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    shift = input_len if mode == "contiguous" else 0
    history = x_test.select("window_id", "time_step", nan_to_null(F.col("close").cast("double")).alias("price"), F.lit(0).alias("seg"))
    truth = y_true.select("window_id", (F.col("time_step") + shift).alias("time_step"), nan_to_null(F.col("close").cast("double")).alias("price"), F.lit(1).alias("seg"))
    lagged = history.unionByName(truth).withColumn("prev_price", F.lag("price").over(W.partitionBy("window_id").orderBy("time_step", "seg")))
    prev = lagged.where(F.col("prev_price").isNotNull() & F.col("time_step").isNotNull() & F.col("window_id").isNotNull())
    return prev.select("window_id", (F.col("time_step") - shift).alias("time_step"), "prev_price")


def returns_base(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, mode: str = "literal", input_len: int = INPUT_LEN) -> Returns:
    """(truth with all its columns, prev_price and true_ret; window_id, time_step and pred_ret)."""
    prev = previous_prices(y_true, x_test, mode, input_len)
    true = y_true.join(prev, KEYS).withColumn("true_ret", simple_return(nan_to_null(F.col("close").cast("double")), F.col("prev_price")))
    pred = y_pred.select(*KEYS, "pred_close").join(prev, KEYS).withColumn("pred_ret", simple_return(nan_to_null(F.col("pred_close").cast("double")), F.col("prev_price")))
    return Returns(true, pred.select(*KEYS, "pred_ret"))


def joined_returns(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, mode: str = "literal", input_len: int = INPUT_LEN) -> DataFrame:
    """Truth's and prediction's returns side by side, joined on window and step: truth's columns, prev_price, true_ret, pred_ret.

    The three tables are dealt by window once. Each price gets the one before it there, and the rows of one step, with each of their
    previous prices, meet where they are; so a row fans out as it would in joins of returns_base()'s two tables.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    shift = input_len if mode == "contiguous" else 0
    number = lambda df, c: nan_to_null(df[c].cast("double"))
    row = F.struct(*(F.col(f"`{c}`") for c in y_true.columns))
    none = F.lit(None)

    def part(df: DataFrame, seg: int, step, price, truth, pred) -> DataFrame:
        return df.select("window_id", step.cast("long").alias("step"), F.lit(seg).alias("seg"), price.alias("price"), truth.alias("truth"), pred.alias("pred"))

    at, kind = F.col("time_step"), row_type(y_true)
    rows = part(x_test, 0, at, number(x_test, "close"), none.cast(kind), none.cast("double"))
    rows = rows.unionByName(part(y_true, 1, at + shift, number(y_true, "close"), row, none.cast("double")))
    # A prediction that is missing is a row too, so it is told by its segment.
    rows = rows.unionByName(part(y_pred, 2, at + shift, none.cast("double"), none.cast(kind), number(y_pred, "pred_close")))
    rows = rows.where(F.col("window_id").isNotNull()).repartition("window_id")
    price = F.col("seg") < 2
    before = F.lag("price").over(W.partitionBy("window_id", price).orderBy("step", "seg"))
    held = rows.withColumn("before", F.when(price, before)).where(F.col("step").isNotNull()).groupBy("window_id", "step").agg(
        F.collect_list("before").alias("prev"),
        F.collect_list(F.when(F.col("seg") == 1, F.col("truth"))).alias("truth"),
        F.collect_list(F.when(F.col("seg") == 2, F.struct("pred"))).alias("pred"),
    )
    out = held.select(F.inline("truth"), F.col("prev").alias("__prev"), F.col("pred").alias("__pred"))
    out = out.withColumn("prev_price", F.explode("__prev")).select("*", F.inline("__pred").alias("__close")).withColumn("__before", F.explode("__prev"))
    true_ret = simple_return(nan_to_null(F.col("close").cast("double")), F.col("prev_price"))
    columns = [F.col(f"`{c}`") for c in y_true.columns]
    return out.select(*columns, "prev_price", true_ret.alias("true_ret"), simple_return(F.col("__close"), F.col("__before")).alias("pred_ret"))


def row_type(df: DataFrame) -> str:
    """A table's rows as a struct type, for nulls of it."""
    return df.schema.simpleString()
