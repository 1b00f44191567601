"""Sampling of fixed-length windows from long series, by row position.

Positions come from two levels, steps in spans of time and spans in the series, and windows from blocks of positions
with the rows that the block's last windows need from the next. So one very long series is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.sources.schemas import HORIZON, INPUT_LEN, WINDOW, require_columns

REQUIRED = ("series_id", "time_step", "close", "volume")
#: time_step values of a span, and rows of a block.
SPAN = 1 << 16
BLOCK = 4096
#: Tasks a core, at least, that make rows of windows.
TASKS = 4
#: Windows whose rows are made from one row of arrays. Spark holds all rows it makes of one row before it passes them on: few stay in
#: the processor's cache, those of a whole block do not.
GROUP = 16


def stride(rolling: bool = True, step_size: int | None = 1, window: int = WINDOW) -> int:
    """Rows from one window's start to the next's. A step_size always wins over `rolling`; pass None for the latter's rule."""
    if step_size is not None:
        return step_size
    return 1 if rolling else window


def check_lengths(window: int, input_len: int, horizon_len: int) -> None:
    if input_len + horizon_len != window:
        raise ValueError("input and horizon must add up to the window")


def spans(df: DataFrame) -> DataFrame:
    """series_id, span, __size, close, volume: the rows of a span of time_step values as two arrays of numbers, by time_step (then close
    and volume). A row is moved and sorted as a row no more."""
    require_columns(df, REQUIRED)
    held = df.groupBy("series_id", F.floor(F.col("time_step") / SPAN).alias("span")).agg(F.sort_array(F.collect_list(F.struct("time_step", "close", "volume"))).alias("rows"))
    return held.select("series_id", "span", F.size("rows").alias("__size"), *(F.col(f"rows.{c}").cast("array<double>").alias(c) for c in ("close", "volume")))


def placed_spans(df: DataFrame, step: int = 1, window: int = WINDOW, numbered: bool = True, dense: bool = False) -> DataFrame:
    """spans() with `at`, the place of their first row in the series, and if `numbered` with `before`, how many windows all series of
    lower ids have at stride `step`; then series without a window are left out. With `dense`, time_step is the row's place in its series
    already, as in the bars of fixtures.py, so spans need not be counted to be placed, for which rows were sorted a second time."""
    if dense:
        held = spans(df.where(F.col("series_id").isNotNull())).withColumn("at", F.col("span") * SPAN)
        return held.join(first_windows(df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), step, window), "series_id") if numbered else held
    sizes = df.groupBy("series_id", F.floor(F.col("time_step") / SPAN).alias("span")).agg(F.count(F.lit(1)).alias("__rows"))
    before = W.partitionBy("series_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("series_id", "span", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("at"))
    if numbered:
        starts = starts.join(first_windows(sizes.groupBy("series_id").agg(F.sum("__rows").alias("n")), step, window), "series_id")
    return spans(df).join(starts, ["series_id", "span"])


def first_windows(sizes: DataFrame, step: int, window: int = WINDOW) -> DataFrame:
    """series_id, before: how many windows the series of lower ids have, from (series_id, n), for series that have one."""
    counts = sizes.where(F.col("n") >= window).select("series_id", (F.floor((F.col("n") - window) / step) + 1).alias("__size"))
    return _first_numbers(counts).withColumnRenamed("__first", "before")


def blocks(df: DataFrame, step: int = 1, window: int = WINDOW, numbered: bool = True, parts: int | None = None, dense: bool = False) -> DataFrame:
    """series_id, block, first, close, volume, and if `numbered` before: stretches of BLOCK positions of a series with the rows that their
    last windows need from the next, as two arrays of numbers in order; `first` is the position of the first. Short series give
    none, or blocks without a window if not `numbered`.

    Blocks are put together from slices of spans; most have one. They are dealt to `parts` tasks, if told, so that those of a long
    series part. `dense` is that of placed_spans()."""
    held = placed_spans(df, step, window, numbered, dense)
    end = F.col("at") + F.col("__size")
    first = F.greatest(F.floor((F.col("at") - (window - 1)) / BLOCK), F.lit(0))  # its last windows need the span's first rows
    cut = held.withColumn("end", end).withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / BLOCK))))
    low = F.greatest(F.col("block") * BLOCK, F.col("at"))
    high = F.least((F.col("block") + 1) * BLOCK + (window - 1), F.col("end"))
    cut = cut.withColumns({"first": low, "__rows": (high - low).cast("int")}).where("__rows > 0")
    skip = (F.col("first") - F.col("at") + 1).cast("int")
    piece = F.struct("first", *(F.slice(c, skip, F.col("__rows")).alias(c) for c in ("close", "volume")))
    more = [F.first("before").alias("before")] if numbered else []
    dealt = cut.select("series_id", "block", piece.alias("piece"), *(["before"] if numbered else []))
    dealt = dealt.repartition(parts, "series_id", "block") if parts else dealt.repartition("series_id", "block")
    whole = dealt.groupBy("series_id", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), *more)
    return whole.select("series_id", "block", F.element_at("pieces", 1)["first"].alias("first"), *(["before"] if numbered else []), *(F.flatten(f"pieces.{c}").alias(c) for c in ("close", "volume")))


def _cut(held: DataFrame, step: int, window: int, group: int = 1) -> DataFrame:
    """blocks() with a row for each window, or for `group` of them one after another: the start of the first, at (where it begins in the
    block's arrays, from 1), and __last (the block's last start)."""
    first = F.col("first")
    cut = held.withColumn("__last", F.least(first + BLOCK, first + F.size("close") - window + 1) - 1)
    begin = F.ceil(first / step) * step
    starts = F.when(begin <= F.col("__last"), F.sequence(begin, F.col("__last"), F.lit(step * group).cast("long")))
    cut = cut.withColumn("start", F.explode(starts))
    return cut.withColumn("at", (F.col("start") - first + 1).cast("int"))


def window_arrays(df: DataFrame, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW) -> DataFrame:
    """series_id, block, start, sample_idx, close, volume: every window as two arrays in order; short series give none.

    sample_idx is dense by series and start. It is a series' first number, which follows from the sizes of the others, and the
    window's place in its series, which follows from its start: no window is sorted or moved to be numbered.
    """
    step = stride(rolling, step_size, window)
    cut = _cut(blocks(df, step, window), step, window)
    index = F.col("before") + F.floor(F.col("start") / step)
    return cut.select("series_id", "block", "start", index.alias("sample_idx"), *(F.slice(c, F.col("at"), window).alias(c) for c in ("close", "volume")))


def tasks(spark: SparkSession) -> int:
    """How many tasks make rows of windows: more than the bytes of their blocks would ask for, as a bar becomes as many rows as a window has."""
    return max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sample_windows(df: DataFrame, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW, input_len: int = INPUT_LEN, horizon_len: int = HORIZON) -> DataFrame:
    """series_id, start, sample_idx, x (a struct of the arrays close and volume over the input rows), y (target closes)."""
    check_lengths(window, input_len, horizon_len)
    return split_xy(window_arrays(df, rolling, step_size, window), input_len, horizon_len)


def split_xy(arrays: DataFrame, input_len: int = INPUT_LEN, horizon_len: int = HORIZON) -> DataFrame:
    """window_arrays() as sample_windows() gives them."""
    x = F.struct(*(F.slice(c, 1, input_len).alias(c) for c in ("close", "volume")))
    return arrays.select("series_id", "start", "sample_idx", x.alias("x"), F.slice("close", input_len + 1, horizon_len).alias("y"))


def long_windows(df: DataFrame, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW) -> DataFrame:
    """series_id, block, start, pos, close, volume: windows as rows; `block` keeps them where they were made. A row's numbers are read
    from the block's arrays: no array is made for a window."""
    step = stride(rolling, step_size, window)
    placed = _cut(blocks(df, step, window, numbered=False, parts=tasks(df.sparkSession)), step, window).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    return placed.select("series_id", "block", "start", "pos", *(F.get(c, F.col("at") - 1 + F.col("pos")).alias(c) for c in ("close", "volume")))


def window_rows(df: DataFrame, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW, dense: bool = False) -> DataFrame:
    """long_windows() without `block`, to be written rather than to be worked on by window: rows are made of GROUP windows at a time."""
    step, parts = stride(rolling, step_size, window), tasks(df.sparkSession)
    cut = _cut(blocks(df, step, window, numbered=False, parts=parts, dense=dense), step, window, GROUP)
    n = F.least(F.floor((F.col("__last") - F.col("start")) / step) + 1, F.lit(GROUP)).cast("int")
    pieces = cut.select("series_id", "start", n.alias("__n"), *(F.slice(c, F.col("at"), (n - 1) * step + window).alias(c) for c in ("close", "volume")))
    # There are `parts` partitions already, so this moves nothing. It parts the code that Spark compiles: what it holds are a piece's rows.
    each = pieces.coalesce(parts).withColumn("__w", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    return each.select("series_id", (F.col("start") + F.col("__w") * step).alias("start"), "pos", *(F.get(c, F.col("__w") * step + F.col("pos")).alias(c) for c in ("close", "volume")))


def window_count(df: DataFrame, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW) -> DataFrame:
    """n_windows over all series: by stride if rolling, else whole windows end to end, whatever the stride."""
    step = stride(rolling, step_size, window)
    n = F.col("n")
    each = F.floor((n - window) / step) + 1 if rolling else F.floor(n / window)
    sizes = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(n >= window, each)), F.lit(0)).alias("n_windows"))


def _first_numbers(sizes: DataFrame) -> DataFrame:
    """series_id, __first: the rows of all series before each, from (series_id, __size). Series are added up in groups
    of neighbouring ids, and only the groups' sums in one task."""
    grouped = sizes.withColumn("__group", F.floor(F.col("series_id") / BLOCK))
    before = lambda w: F.coalesce(F.sum("__size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("__group").agg(F.sum("__size").alias("__size")).select("__group", before(W.orderBy("__group")).alias("__start"))
    inside = grouped.withColumn("__in", before(W.partitionBy("__group").orderBy("series_id")))
    return inside.join(groups, "__group").select("series_id", (F.col("__start") + F.col("__in")).alias("__first"))


def sample_cap(df: DataFrame, most: int, rolling: bool = True, step_size: int | None = 1, window: int = WINDOW) -> DataFrame:
    """sample_windows() of the first `most` windows by series and start.

    Which these are follows from the series' sizes, so only bars of the series that have some are read into windows.
    """
    step = stride(rolling, step_size, window)
    firsts = first_windows(df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), step, window)
    wanted = firsts.where(F.col("before") < most)
    return split_xy(window_arrays(df.join(wanted, "series_id", "left_semi"), rolling, step_size, window).where(F.col("sample_idx") < most))


def first_batches(batched: DataFrame, most: int) -> DataFrame:
    """The rows of the first `most` batches."""
    return batched.where(F.col("batch_id") < most)


def batches(indexed: DataFrame, batch_size: int) -> DataFrame:
    """`batch_id` and the place in the batch; the last batch may be short."""
    return indexed.withColumn("batch_id", F.floor(F.col("sample_idx") / batch_size)).withColumn("in_batch", F.col("sample_idx") % batch_size)


def stack(batched: DataFrame, column: str) -> DataFrame:
    """One row a batch with the column's values in order."""
    return batched.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("in_batch", column))), lambda r: r[column]).alias(column))


def shard(indexed: DataFrame, worker: int | Column, workers: int) -> DataFrame:
    """The windows that go to one of several workers in turn."""
    return indexed.where(F.col("sample_idx") % workers == worker)
