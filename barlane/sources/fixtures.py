"""Bar tables made from the driver's star schema, whose own data has no price bars.

Bars are line items by supplier in order of shipping: close is the extended price, volume the quantity. The first 60
rows of a series are history, the next 10 truth (steps 0..9), and predictions follow from the last close of history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.sources.schemas import HORIZON, INPUT_LEN

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "close", "volume")


@dataclass(frozen=True)
class Tables:
    y_true: DataFrame
    y_pred: DataFrame
    x_test: DataFrame


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Renamed before they are sorted, so that a column is moved once and all readers of bars move the same ones.
    names = {"l_suppkey": "series_id", "l_extendedprice": "close", "l_quantity": "volume"}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnsRenamed(names)
    step = F.row_number().over(W.partitionBy("series_id").orderBy(*ORDER)) - 1
    return rows.select("series_id", step.alias("time_step"), "close", "volume")


def first_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that tables are made of."""
    return bars(spark, sf_dir).where(F.col("time_step") < INPUT_LEN + HORIZON)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return tables_of(bars(spark, sf_dir))


def tables_of(all_bars: DataFrame) -> Tables:
    b = all_bars.withColumnRenamed("series_id", "window_id")
    x_test = b.where(F.col("time_step") < INPUT_LEN)
    step = (F.col("time_step") - INPUT_LEN).cast("int")
    y = b.where(F.col("time_step").between(INPUT_LEN, INPUT_LEN + HORIZON - 1)).select("window_id", step.alias("time_step"), "close")
    y_true = y.withColumn("event_datetime", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, time_step, 0)"))
    last = x_test.where(F.col("time_step") == INPUT_LEN - 1).select("window_id", F.col("close").alias("last"))
    pred = F.col("last") * (1 + F.lit(0.001) * (F.col("time_step") + 1) * (F.col("window_id") % 7 - 3))
    y_pred = y.join(last, "window_id").select("window_id", "time_step", pred.alias("pred_close"))
    return Tables(y_true, y_pred, x_test)
