"""Cross-sectional strategies: the return of each at every timestamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlane.functions.columns import clamp_low, finite_or_zero, nan_to_null, to_event_time
from barlane.operators import ranks
from barlane.operators.returns import joined_returns

# Rows that a cross-section must have, and the default tails.
LEAST_CROSS_SECTION = 3
LEAST_LOTQ = 5
TOP_DECILE = 0.10
TOP_Q = 0.20
NAMES = ("CSM", "LOTQ", "PW")


def least_csm(top_decile: float) -> int:
    """Rows below which the long-short strategy is flat."""
    return max(10, 2 * int(1 / top_decile))


def with_event_time(df: DataFrame) -> DataFrame:
    """event_datetime as a timestamp: strings that are none become null."""
    if dict(df.dtypes)["event_datetime"] == "string":
        return df.withColumn("event_datetime", to_event_time(F.col("event_datetime")))
    return df


def sides(returns: DataFrame) -> DataFrame:
    """event_datetime, p, r of joined returns at every time there is: predicted and true return, NaN as null.

    Rows are dealt by all three. Every branch that reads them has the same exchange, which Spark then makes once, so the
    joins under it run once too.
    """
    rows = with_event_time(returns).where(F.col("event_datetime").isNotNull())
    return rows.select("event_datetime", nan_to_null(F.col("pred_ret")).alias("p"), nan_to_null(F.col("true_ret")).alias("r")).repartition("event_datetime", "p", "r")


def portfolio_table(returns: DataFrame, top_decile: float = TOP_DECILE, top_q: float = TOP_Q) -> DataFrame:
    """event_datetime, n, CSM, LOTQ, PW for each timestamp with enough rows, from joined returns.

    Thresholds are exact quantiles of a cross-section's predictions; ties at a threshold are in its leg. A missing
    prediction makes a cross-section's threshold unknown and its CSM and LOTQ 0; a missing side makes PW 0.
    """
    rows = sides(returns)
    cuts = ranks.quantiles(rows, ["event_datetime"], "p", (top_decile, 1 - top_q, 1 - top_decile), "cut")
    p, r = F.col("p"), F.col("r")
    weight = clamp_low(p)
    legs = rows.join(cuts, "event_datetime", "left").groupBy("event_datetime").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("p").alias("np"),
        F.count("r").alias("nr"),
        F.avg(F.when(p >= F.col("cut")[2], r)).alias("top"),
        F.avg(F.when(p <= F.col("cut")[0], r)).alias("bottom"),
        F.avg(F.when(p >= F.col("cut")[1], r)).alias("long"),
        F.sum(weight * r).alias("gain"),
        F.sum(weight).alias("weight"),
    ).where(F.col("n") >= LEAST_CROSS_SECTION)
    n = F.col("n")
    known, whole = F.col("np") == n, (F.col("np") == n) & (F.col("nr") == n)
    csm = F.when(known & (n >= least_csm(top_decile)), F.col("top") - F.col("bottom"))
    lotq = F.when(known & (n >= LEAST_LOTQ), F.col("long"))
    pw = F.when(whole & (F.col("weight") > 0), F.try_divide(F.col("gain"), F.col("weight")))
    return legs.select("event_datetime", "n", finite_or_zero(csm).alias("CSM"), finite_or_zero(lotq).alias("LOTQ"), finite_or_zero(pw).alias("PW"))


def portfolio_series(returns: DataFrame, top_decile: float = TOP_DECILE, top_q: float = TOP_Q) -> DataFrame:
    """event_datetime, strategy, ret for all three strategies, from one pass over the returns."""
    table = portfolio_table(returns, top_decile, top_q)
    return table.unpivot(["event_datetime"], list(NAMES), "strategy", "ret")


def _one(name: str, y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, mode: str, **tails: float) -> DataFrame:
    if "event_datetime" not in y_true.columns:
        return y_true.sparkSession.createDataFrame([], "event_datetime timestamp_ntz, ret double")
    table = portfolio_table(joined_returns(y_true, y_pred, x_test, mode), **tails)
    return table.select("event_datetime", F.col(name).alias("ret"))


def csm(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, top_decile: float = TOP_DECILE, mode: str = "literal") -> DataFrame:
    """Long the top tail of predictions, short the bottom one."""
    return _one("CSM", y_true, y_pred, x_test, mode, top_decile=top_decile)


def lotq(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, topq: float = TOP_Q, mode: str = "literal") -> DataFrame:
    """Long the top quantile of predictions."""
    return _one("LOTQ", y_true, y_pred, x_test, mode, top_q=topq)


def pw(y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, mode: str = "literal") -> DataFrame:
    """Long in proportion to positive predictions."""
    return _one("PW", y_true, y_pred, x_test, mode)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"CSM": csm, "LOTQ": lotq, "PW": pw, "PROPORTIONAL": pw}


def run_strategy(name: str, y_true: DataFrame, y_pred: DataFrame, x_test: DataFrame, **options) -> DataFrame:
    """A strategy's return series by its name, in any case; ValueError for a name that there is not."""
    found = STRATEGIES.get(name.upper())
    if found is None:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return found(y_true, y_pred, x_test, **options)

