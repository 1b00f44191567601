"""Ranks and exact quantiles inside groups of any size, without a task that holds a group.

Equal values are counted into one row first. A group's values are then parted into classes that keep their order, numbers
run inside a class, and start at the count of values in lower classes. So the largest piece of work is a class: the
distinct values of one group within a factor of 2 ** (1 / SPLITS).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Classes between a magnitude and its double.
SPLITS = 256
# The exponents of the smallest and of the largest double.
LEAST_EXPONENT, MOST_EXPONENT = -1074, 1024


def order_class(value: Column) -> Column:
    """A whole number that never falls while a number rises; null for null."""
    exponent = F.least(F.log2(F.abs(value)), F.lit(float(MOST_EXPONENT)))
    size = F.floor((exponent - LEAST_EXPONENT) * SPLITS) + 1
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def positions(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, value, ties, before, total: for each distinct value how many rows of its group hold it, how many hold a
    lower one, and how many hold any. A null value counts nowhere; its row stays, so that no group is lost."""
    counts = rows.groupBy(*group, value).agg(F.count(value).alias("ties")).withColumn("class", order_class(F.col(value)))
    lower = W.partitionBy(*group, "class").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    lower_classes = W.partitionBy(*group).orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    classes = counts.groupBy(*group, "class").agg(F.sum("ties").alias("size"))
    classes = classes.withColumns({"start": F.coalesce(F.sum("size").over(lower_classes), F.lit(0)), "total": F.sum("size").over(W.partitionBy(*group))})
    inside = counts.withColumn("inside", F.coalesce(F.sum("ties").over(lower), F.lit(0)))
    same = [inside[c].eqNullSafe(classes[c]) for c in (*group, "class")]
    return inside.join(classes, same).select(*(inside[c] for c in (*group, value, "ties")), (F.col("start") + F.col("inside")).alias("before"), "total")


def average_ranks(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """group, value, `name`: the rank of each value in its group, from 1; equal values share the mean of their ranks."""
    at = positions(rows, group, value)
    return at.select(*group, value, (F.col("before") + (F.col("ties") + 1) / F.lit(2.0)).alias(name))


def quantiles(rows: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], name: str) -> DataFrame:
    """group, `name`: the exact quantiles of a group's values that are not null, linear between neighbours, as an array;
    nulls in a group without values.

    Rows are first counted by class, where they are; only values of the classes that hold a quantile are then looked at.
    """
    whole, lower = W.partitionBy(*group), W.partitionBy(*group).orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select(*group, value, order_class(F.col(value)).alias("class"))
    classes = rows.groupBy(*group, "class").agg(F.count(value).alias("size"))
    classes = classes.withColumns({"start": F.coalesce(F.sum("size").over(lower), F.lit(0)), "total": F.sum("size").over(whole)})

    def places(q: float) -> tuple[Column, Column, Column]:
        place = F.lit(float(q)) * (F.col("total") - 1)
        return place, F.floor(place), F.ceil(place)

    def holds(index: Column, first: str, size: str) -> Column:
        return (F.col(first) <= index) & (index < F.col(first) + F.col(size))

    # A group without values keeps its class of nulls, so that no group is lost.
    some = F.col("total") == 0
    for q in shares:
        _, low, high = places(q)
        some = some | holds(low, "start", "size") | holds(high, "start", "size")
    keys = (*group, "class")
    asked = classes.where(some).select(*(F.col(c).alias(f"asked {c}") for c in keys), "start", "total")
    near = rows.join(asked, [F.col(c).eqNullSafe(F.col(f"`asked {c}`")) for c in keys])
    ties = near.groupBy(*group, "class", value).agg(F.count(value).alias("ties"), F.first("start").alias("start"), F.first("total").alias("total"))
    inside = W.partitionBy(*group, "class").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    at = ties.withColumn("before", F.col("start") + F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    picks = [F.max(F.when(holds(index, "before", "ties"), F.col(value))) for q in shares for index in places(q)[1:]]
    found = at.groupBy(*group).agg(F.first("total").alias("total"), *(p.alias(f"pick{i}") for i, p in enumerate(picks)))
    out = []
    for i, q in enumerate(shares):
        low, high, (place, floor, _) = F.col(f"pick{2 * i}"), F.col(f"pick{2 * i + 1}"), places(q)
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (place - floor)))
    return found.select(*group, F.array(*out).alias(name))
