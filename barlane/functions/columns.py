"""Column expressions with the engine's rules for missing and non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formulas: added to denominators, and to prices inside logarithms.
EPS = 1e-12
LOG_EPS = 1e-6


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def is_finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def finite_or_zero(c: Column) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(0.0))


def simple_return(price: Column, before: Column) -> Column:
    """price over the price before it, minus 1; null where the divisor is exactly 0."""
    return F.try_divide(price, before + F.lit(EPS)) - F.lit(1.0)


def log_price(price: Column) -> Column:
    """ln(price + LOG_EPS); null for a sum of 0 or less."""
    return F.ln(price + F.lit(LOG_EPS))


def correlation(x: str, y: str) -> Column:
    """Aggregate: the Pearson correlation, null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def to_event_time(c: Column) -> Column:
    """A timestamp from a string, null where it is none; timestamps stay. A time without a zone is in UTC, whatever the
    session's zone is."""
    text = c.cast("string")
    zoned = text.rlike(r"\d:\d{1,2}(:\d{1,2}(\.\d*)?)?\s*[A-Za-z+-]")
    plain = F.concat(text.try_cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(plain)


def clamp_low(c: Column) -> Column:
    """max(c, 0), null for null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
