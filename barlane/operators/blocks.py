"""Features of all windows of a block at once, as array columns, without making rows of them.

A block is a stretch of a series in two arrays of numbers, of which each window is a slice. Sums over windows are differences of the
block's prefix sums, which are taken of centred values in extended precision. So a window's moments and volume-weighted means
cost a subtraction each, and nothing is shuffled or sorted after the block is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlane.functions.cluster import ship
from barlane.operators import windows
from barlane.sources.schemas import HORIZON, INPUT_LEN

#: Windows of an Arrow batch that goes back to Spark.
BATCH = 1024
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, and of all, in extended precision."""
    return np.append(np.zeros(1, np.longdouble), np.cumsum(values, dtype=np.longdouble))


class Sliding:
    """A column of which each window is a slice of one array; its first number may be another one. NaN stands for null."""

    def __init__(self, values: np.ndarray, first: float | None = None) -> None:
        self.values, self.first = values, first

    def dense(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = np.lib.stride_tricks.sliding_window_view(self.values, length)[starts]
        if self.first is not None:
            out[:, 0] = self.first
        return out

    def laid(self, starts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, int, np.ndarray, int]:
        """Numbers of windows `step` apart, how far on the next window's are, those that windows begin with instead, in rows (one for
        all windows or one for each), and how many these are."""
        heads = np.empty((1, 0)) if self.first is None else np.full((1, 1), self.first)
        return self.values[starts[0] : starts[-1] + length], step, heads, heads.shape[1]

    def mapped(self, of: Callable[[np.ndarray], np.ndarray]) -> Sliding:
        return Sliding(of(self.values), self.first if self.first is None else float(of(np.array([self.first]))[0]))

    def moments(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and population deviation of each window's numbers that are not null; exactly 0 where they are all equal."""
        if np.isnan(self.values).any():
            return Dense(self.dense(starts, length)).moments(starts, length)
        lead = self.first is not None
        begin, end, middle = starts + lead, starts + length, self.values.mean()
        x = self.values - middle
        total, squares, changes = (prefix(v) for v in (x, x.astype(np.longdouble) ** 2, np.append(False, x[1:] != x[:-1])))
        total, squares = total[end] - total[begin], squares[end] - squares[begin]
        equal = changes[end] - changes[np.minimum(begin + 1, end)] == 0
        if lead:
            total, squares = total + (self.first - middle), squares + np.longdouble(self.first - middle) ** 2
            equal &= (begin == end) | (self.values[np.minimum(begin, len(x) - 1)] == self.first)
        mean = total / length
        spread = np.sqrt(np.maximum(squares / length - mean * mean, 0))
        return (mean + middle).astype(np.float64), np.where(equal, 0.0, spread).astype(np.float64)


class Dense:
    """A column whose windows are rows of a matrix, or of one that a function makes when it is first asked for."""

    def __init__(self, rows: np.ndarray | Callable[[], np.ndarray]) -> None:
        self._rows = rows

    @property
    def rows(self) -> np.ndarray:
        if callable(self._rows):
            self._rows = self._rows()
        return self._rows

    def dense(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.rows

    def laid(self, starts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, int, np.ndarray, int]:
        return np.ascontiguousarray(self.rows).ravel(), length, np.empty((1, 0)), 0

    def mapped(self, of: Callable[[np.ndarray], np.ndarray]) -> Dense:
        return Dense(of(self.rows))

    def moments(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return moments(self.rows)


class Headed(Dense):
    """A column whose windows are slices of one array but for their first numbers, which a function gives: the array, and a row of first
    numbers for each window."""

    def __init__(self, parts: Callable[[], tuple[np.ndarray, np.ndarray]], starts: np.ndarray, length: int) -> None:
        self.parts, self.starts, self.length = parts, starts, length
        super().__init__(self._whole)

    def _whole(self) -> np.ndarray:
        values, heads = self.parts()
        out = np.array(np.lib.stride_tricks.sliding_window_view(values, self.length)[self.starts])
        out[:, : heads.shape[1]] = heads
        return out

    def laid(self, starts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, int, np.ndarray, int]:
        values, heads = self.parts()
        return values[starts[0] : starts[-1] + length], step, heads, heads.shape[1]

    def mapped(self, of: Callable[[np.ndarray], np.ndarray]) -> Headed:
        return Headed(lambda: tuple(of(x) for x in self.parts()), self.starts, self.length)


def pieces(laid: tuple[np.ndarray, int, np.ndarray, int], n: int, length: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of `n` windows laid() out, cut into arrays of `group` windows each and put one after another: all numbers, where each
    array begins and the last ends, and the place in each where its windows' first numbers begin."""
    values, by, heads, _ = laid
    full, rest = divmod(n, group)
    out, sizes, leads = [], [], []
    for begin, count, windows_each in ((0, full, group), (full * group, min(rest, 1), rest)):
        if not count:
            continue
        width = (windows_each - 1) * by + length
        cut = np.lib.stride_tricks.sliding_window_view(values[begin * by :], width)[:: group * by][:count]
        own = heads[begin : begin + count * windows_each].reshape(count, -1) if len(heads) > 1 or n == 1 else np.repeat(heads, count, 0)
        out.append(np.concatenate([cut, own], 1).ravel())
        sizes.append(np.full(count, width + own.shape[1]))
        leads.append(np.full(count, width))
    return np.concatenate(out), np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32), np.concatenate(leads).astype(np.int32)


def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each row's numbers that are not null; exactly 0 where they are all equal."""
    have = ~np.isnan(rows)
    n = have.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(have, rows, 0).sum(1) / n
        away = np.where(have, rows - mean[:, None], 0)
        spread = np.sqrt((away * away).sum(1) / n)
    low, high = np.where(have, rows, np.inf).min(1), np.where(have, rows, -np.inf).max(1)
    return mean, np.where(low == high, 0.0, spread)


class Block:
    """Windows of one stretch: where each begins in its arrays, their columns, numbers a window (`scalars`), and the keys of noise."""

    def __init__(self, series: int, first: int, starts: np.ndarray, length: int, close: np.ndarray, volume: np.ndarray) -> None:
        self.series, self.first, self.starts, self.length = series, first, starts, length
        self.columns: dict[str, Sliding | Dense] = {"close": Sliding(close), "volume": Sliding(volume)}
        self.scalars: dict[str, np.ndarray] = {}

    def dense(self, name: str) -> np.ndarray:
        return self.columns[name].dense(self.starts, self.length)

    def moments(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return self.columns[name].moments(self.starts, self.length)

    def keys(self) -> tuple:
        """series, start and place of every number, to be broadcast."""
        return self.series, (self.first + self.starts)[:, None], np.arange(self.length)[None]


def _through(pipeline, block: Block, inverse: bool) -> Block:
    if pipeline is not None:
        pipeline.on_block(block)
        if inverse:
            pipeline.off_block(block)
    return block


def rounded(x: np.ndarray, digits: int, nudge: float = 0.0) -> np.ndarray:
    """x + nudge to `digits` decimals, halves away from 0, without negative zeros. Numbers too large to have such decimals stay."""
    x = x + nudge
    scaled = np.abs(x) * 10.0**digits
    with np.errstate(invalid="ignore"):
        return np.where(scaled < 2.0**52, np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x), x) + 0.0


def _mapped(df: DataFrame, pipeline, rolling: bool, step_size: int | None, input_len: int, horizon_len: int, inverse: bool, schema: Callable[[Block], str], give: Callable[[Block, int, np.ndarray, np.ndarray | None, Callable[[], np.ndarray]], list[pa.Array]], numbered: bool = False, dense: bool = False) -> DataFrame:
    """What `give` makes of all windows: of each Block through the pipeline, with its series, its windows' starts and numbers (if `numbered`), and their
    target closes when asked for. `schema` has the columns after series_id and start, and may look at a block."""
    spark = df.sparkSession
    ship(spark)
    if not spark.conf.get(_BYTES, None):
        spark.conf.set(_BYTES, str(64 << 20))
    length = input_len + horizon_len
    step = windows.stride(rolling, step_size, length)
    one = _through(pipeline, Block(0, 0, np.zeros(1, np.int64), input_len, np.ones(input_len), np.ones(input_len)), inverse)
    held = windows.blocks(df, step, length, numbered, windows.tasks(spark), dense).select("series_id", "first", F.col("before") if numbered else F.lit(0).alias("before"), "close", "volume")
    kind = held.schema["series_id"].dataType.simpleString()
    fields = f"series_id {kind}, start long, {schema(one)}"
    names = T.StructType.fromDDL(fields).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                series, first, before = (batch.column(c)[r].as_py() for c in range(3))
                close, volume = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in (3, 4))
                begin = -(-first // step) * step - first
                every = np.arange(begin, min(windows.BLOCK, len(close) - length + 1), step)
                for part in np.array_split(every, -(-len(every) // BATCH)) if len(every) else ():
                    low = int(part[0])
                    high = int(part[-1]) + length
                    block = _through(pipeline, Block(series, first + low, part - low, input_len, close[low:high], volume[low:high]), inverse)
                    starts = first + part
                    y = lambda at=part, of=close: of[at[:, None] + np.arange(input_len, length)]
                    yield pa.RecordBatch.from_arrays(give(block, series, starts, before + starts // step if numbered else None, y), names)

    return held.mapInArrow(run, fields)


def features(df: DataFrame, pipeline=None, rolling: bool = True, step_size: int | None = 1, input_len: int = INPUT_LEN, horizon_len: int = HORIZON, inverse: bool = False) -> DataFrame:
    """series_id, start, sample_idx, an array of the input rows for each of the pipeline's columns, its scalars (moments of scaled
    columns), and y, the target closes. Windows are those of sample_windows(); `pipeline` is a Transform.

    With `inverse` its steps are undone again, from the last to the first. A null stays null, and is left out of moments.
    """

    def schema(one: Block) -> str:
        return "sample_idx long, " + "".join(f"`{c}` array<double>, " for c in one.columns) + "".join(f"`{c}` double, " for c in one.scalars) + "y array<double>"

    def arrays(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(m).ravel(), from_pandas=True))

    def give(block, series, starts, numbers, y) -> list[pa.Array]:
        columns = [arrays(block.dense(c)) for c in block.columns] + [pa.array(x, from_pandas=True) for x in block.scalars.values()]
        return [pa.array(np.full(len(starts), series)), pa.array(starts), pa.array(numbers), *columns, arrays(y())]

    return _mapped(df, pipeline, rolling, step_size, input_len, horizon_len, inverse, schema, give, numbered=True)


def rows(df: DataFrame, pipeline, names: Sequence[str], rolling: bool = True, step_size: int | None = 1, input_len: int = INPUT_LEN, horizon_len: int = HORIZON, inverse: bool = False, of: Callable[[np.ndarray], np.ndarray] | None = None, dense: bool = False) -> DataFrame:
    """features() as rows: series_id, start, pos and a number for each of `names`, of which `of` is taken, a function of arrays.

    Of each windows.GROUP windows one row comes back, with an array for each column: the slid-over one and the numbers that windows begin
    with instead, or all windows' numbers one after another. Spark then makes the rows and reads their numbers from it, so keys are not
    moved, nor a number once for each window it is in. `dense` is that of windows.placed_spans().
    """
    step, group = windows.stride(rolling, step_size, input_len + horizon_len), windows.GROUP

    def give(block, series, starts, numbers, y) -> list[pa.Array]:
        n, firsts = len(starts), starts[::group]
        out = [pa.array(np.full(len(firsts), series)), pa.array(firsts), pa.array(np.minimum(n - np.arange(0, n, group), group).astype(np.int32))]
        for c in names:
            laid = (block.columns[c].mapped(of) if of else block.columns[c]).laid(block.starts, block.length, step)
            values, offsets, leads = pieces(laid, n, block.length, group)
            _, by, heads, wide = laid
            out += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, from_pandas=True)), pa.array(leads)]
            out += [pa.array(np.full(len(firsts), x, np.int32)) for x in (by, wide, wide if len(heads) == n else 0)]
        return out

    laid = ", ".join(f"`__{k}` array<double>, `__{k}_lead` int, `__{k}_by` int, `__{k}_wide` int, `__{k}_head_by` int" for k in range(len(names)))
    parts = _mapped(df, pipeline, rolling, step_size, input_len, horizon_len, inverse, lambda _: f"__n int, {laid}", give, dense=dense)
    each = parts.withColumn("__w", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(input_len - 1))))
    at = lambda k: F.col("pos") + F.when(F.col("pos") < F.col(f"__{k}_wide"), F.col(f"__{k}_lead") + F.col("__w") * F.col(f"__{k}_head_by")).otherwise(F.col("__w") * F.col(f"__{k}_by"))
    return each.select("series_id", (F.col("start") + F.col("__w") * step).alias("start"), "pos", *(F.get(f"__{k}", at(k)).alias(c) for k, c in enumerate(names)))


def standardisation(df: DataFrame, pipeline, names: Sequence[str], rolling: bool = True, step_size: int | None = 1, input_len: int = INPUT_LEN, horizon_len: int = HORIZON, dense: bool = False) -> DataFrame:
    """series_id, start, and as NAME_m and NAME_s the mean and population deviation of each column's numbers after the pipeline."""

    def give(block, series, starts, numbers, y) -> list[pa.Array]:
        found = [pa.array(x, from_pandas=True) for c in names for x in moments(block.dense(c))]
        return [pa.array(np.full(len(starts), series)), pa.array(starts), *found]

    return _mapped(df, pipeline, rolling, step_size, input_len, horizon_len, False, lambda _: ", ".join(f"`{c}_m` double, `{c}_s` double" for c in names), give, dense=dense)


def long(featured: DataFrame, names: Sequence[str]) -> DataFrame:
    """features() as rows: series_id, start, pos and a number for each of the columns."""
    zipped = F.posexplode(F.arrays_zip(*names)).alias("pos", "row")
    return featured.select("series_id", "start", zipped).select("series_id", "start", "pos", *(F.col(f"row.{c}").alias(c) for c in names))
