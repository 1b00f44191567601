"""Error, rank and risk metrics, each as a one-row DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.functions.columns import EPS, correlation, is_finite, nan_to_null
from barlane.operators import ranks, strategies
from barlane.operators.returns import KEYS, joined_returns

# Fixed value: rows that a cross-section must have to count.
LEAST_CROSS_SECTION = 3


def errors(y_true: DataFrame, y_pred: DataFrame) -> DataFrame:
    """mse, mae over the rows that both have; null over none."""
    diff = nan_to_null(F.col("close").cast("double") - F.col("pred_close").cast("double"))
    both = y_true.select(*KEYS, "close").join(y_pred.select(*KEYS, "pred_close"), KEYS).select(diff.alias("d"))
    return both.agg(F.avg(F.col("d") * F.col("d")).alias("mse"), F.avg(F.abs("d")).alias("mae"))


def mse(y_true: DataFrame, y_pred: DataFrame) -> DataFrame:
    return errors(y_true, y_pred).select("mse")


def mae(y_true: DataFrame, y_pred: DataFrame) -> DataFrame:
    return errors(y_true, y_pred).select("mae")


def ic_by_timestamp(returns: DataFrame) -> DataFrame:
    """event_datetime, n, ic: the rank correlation of predicted and true returns in each cross-section of enough rows.

    The size counts all rows; pairs with a missing side are left out before ranking. Cross-sections in which a side
    does not vary have no ic and are left out. Times may be strings; those that are no time are left out.
    """
    at, both = ["event_datetime"], F.col("p").isNotNull() & F.col("r").isNotNull()
    rows = strategies.sides(returns).select("event_datetime", F.when(both, F.col("p")).alias("p"), F.when(both, F.col("r")).alias("r"))
    ranked = rows.join(ranks.average_ranks(rows, at, "p", "rp"), [*at, "p"], "left").join(ranks.average_ranks(rows, at, "r", "rr"), [*at, "r"], "left")
    ics = ranked.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), correlation("rp", "rr").alias("ic"))
    return ics.where((F.col("n") >= LEAST_CROSS_SECTION) & is_finite(F.col("ic")))


def ic_ir(ics: DataFrame) -> DataFrame:
    """ic, ir of ic_by_timestamp()'s rows: their mean, and their mean over their deviation; 0 where there are too few."""
    n, mean = F.count("ic"), F.avg("ic")
    return ics.agg(F.coalesce(mean, F.lit(0.0)).alias("ic"), F.when(n < 2, 0.0).otherwise(mean / (F.stddev_pop("ic") + EPS)).alias("ir"))


def _sharpe() -> Column:
    return F.coalesce(F.avg("ret") / (F.stddev_pop("ret") + EPS), F.lit(0.0)).alias("sharpe")


def _drawdown() -> Column:
    return F.max((F.col("peak") - F.col("equity")) / (F.col("peak") + EPS)).alias("mdd")


def _tail() -> tuple[Column, Column]:
    var = F.first("var")
    return var.alias("var"), F.coalesce(F.avg(F.when(F.col("ret") <= F.col("var"), F.col("ret"))), var).alias("es")


def sharpe(series: DataFrame) -> DataFrame:
    """strategy, sharpe of return series (event_datetime, strategy, ret); not annualised."""
    return series.groupBy("strategy").agg(_sharpe())


def equity_curve(series: DataFrame) -> DataFrame:
    """The running product of 1 + ret by time, and its running maximum, which starts at the first equity.

    A scan of two levels: products, and their largest and smallest so far, inside each day of a strategy, then over the days' totals.
    So a task holds a strategy's day, or its days, but not all its timestamps. A missing return changes nothing.
    """
    day, inside = F.to_date("event_datetime"), ["strategy", "__day"]
    run = W.partitionBy(*inside).orderBy("event_datetime").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = series.withColumn("__day", day).withColumn("__equity", F.product(1 + F.col("ret")).over(run))
    rows = rows.withColumns({"__high": F.max("__equity").over(run), "__low": F.min("__equity").over(run)})
    days = rows.groupBy(*inside).agg(F.product(1 + F.col("ret")).alias("total"), F.max("__equity").alias("high"), F.min("__equity").alias("low"))
    earlier = W.partitionBy("strategy").orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("base", F.product("total").over(earlier))
    days = days.withColumn("before", F.max(_peak("base", "high", "low")).over(earlier))
    days = days.select(F.col("strategy").alias("__of"), F.col("__day").alias("__on"), "base", "before")
    found = rows.join(days, F.col("strategy").eqNullSafe(F.col("__of")) & F.col("__day").eqNullSafe(F.col("__on")))
    equity, peak = _scaled("base", "__equity"), F.greatest("before", _peak("base", "__high", "__low"))
    return found.select(*(F.col(f"`{c}`") for c in series.columns), equity.alias("equity"), peak.alias("peak"))


def _scaled(base: str, value: str) -> Column:
    """The product of both, or the one that is there."""
    return F.coalesce(F.col(base) * F.col(value), F.col(base), F.col(value))


def _peak(base: str, high: str, low: str) -> Column:
    """The largest equity of a stretch that begins at `base`: below 0 that is where the stretch is lowest."""
    return F.when(F.col(base) < 0, _scaled(base, low)).otherwise(_scaled(base, high))


def max_drawdown(series: DataFrame) -> DataFrame:
    """strategy, mdd."""
    return equity_curve(series).groupBy("strategy").agg(_drawdown())


def with_var(series: DataFrame, alpha: float) -> DataFrame:
    """A series with var, a quantile of its strategy's returns, in every row. One task holds a strategy's returns."""
    return series.withColumn("var", F.percentile("ret", F.lit(alpha)).over(W.partitionBy("strategy")))


def var_es(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """strategy, var (a quantile of returns, negative for a loss), es (mean of returns at or below it)."""
    return with_var(series, alpha).groupBy("strategy").agg(*_tail())


def risk(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """strategy, sharpe, mdd, var, es for all three strategies, from one pass over the series; zeros where one is empty."""
    names = series.sparkSession.createDataFrame([(s,) for s in strategies.NAMES], "strategy string")
    rows = with_var(equity_curve(series), alpha)
    found = rows.groupBy("strategy").agg(_sharpe(), _drawdown(), *_tail())
    return names.join(found, "strategy", "left").select("strategy", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sharpe", "mdd", "var", "es")))


METRICS = ("MSE", "MAE", "IC", "IR", "SharpeRatio", "MDD", "VaR", "ES")


def evaluate_all_metrics(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, alpha: float = 0.05, mode: str = "literal", lazy: bool = False) -> DataFrame:
    """One row with all METRICS; the last four are means over the three strategies.

    The row is computed by this call: joined returns are built once and kept while the rank and strategy branches read
    them, and are let go before the row is returned. With `lazy` nothing is run or kept, and the result is a plan.
    """
    e = errors(y_true, y_pred)
    if "event_datetime" not in y_true.columns:
        return e.select(*(c.alias(m) for c, m in zip((F.col("mse"), F.col("mae"), *(F.lit(0.0),) * 6), METRICS, strict=True)))
    returns = joined_returns(y_true, y_pred, x_test, mode).select("event_datetime", "true_ret", "pred_ret")
    if lazy:
        return _all_metrics(e, returns, alpha)
    returns = returns.persist()
    try:
        row = _all_metrics(e, returns, alpha).first()
    finally:
        returns.unpersist()
    return y_true.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{m} double" for m in METRICS))


def _all_metrics(errors_: DataFrame, returns: DataFrame, alpha: float) -> DataFrame:
    rank = ic_ir(ic_by_timestamp(returns))
    mean = risk(strategies.portfolio_series(returns), alpha).agg(*(F.avg(c).alias(c) for c in ("sharpe", "mdd", "var", "es")))
    row = errors_.join(F.broadcast(rank)).join(F.broadcast(mean))  # one row each
    return row.select(*(F.col(c).alias(m) for c, m in zip(("mse", "mae", "ic", "ir", "sharpe", "mdd", "var", "es"), METRICS, strict=True)))
