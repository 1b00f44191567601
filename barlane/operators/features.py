"""Features of windows, with scaling that can be undone: in long form (rows keyed by KEYS and ordered by pos), or of all windows of
a block at once (blocks.py), where rows would be made of each bar for each window it is in.

Features start anew in each window. Scaling keeps its moments in columns, so any window can be scaled back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlane.functions.columns import LOG_EPS, log_price
from barlane.functions.noise import normal, normal_array
from barlane.operators.blocks import Block, Dense, Headed, Sliding, moments, prefix

KEYS = ("series_id", "block", "start")
FEATURES = ("close", "volume", "log_ret", "vol_delta", "rolling_vol")
VOL_WINDOW = 5


class Transform:
    """A step on long windows; by default it can't be seen in the inverse."""

    keys: Sequence[str] = KEYS

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def invert(self, df: DataFrame) -> DataFrame:
        return df

    def on_block(self, block: Block) -> None:
        """apply() for all windows of a block, whose columns and scalars it changes."""
        raise NotImplementedError

    def off_block(self, block: Block) -> None:
        """invert() for a block."""

    def _rows(self):
        return W.partitionBy(*self.keys).orderBy("pos")


class BasicFeatures(Transform):
    """close, volume, log return, change of volume, and the deviation of the last `vol_window` + 1 log returns.

    The first return and change of a window are 0; the deviation is the population's, over fewer rows at the start.
    """

    def __init__(self, vol_window: int = VOL_WINDOW, keys: Sequence[str] = KEYS) -> None:
        self.vol_window, self.keys = vol_window, keys

    def apply(self, df: DataFrame) -> DataFrame:
        w = self._rows()
        first = F.col("pos") == 0
        price = log_price(F.col("close"))
        out = df.withColumn("log_ret", F.when(first, F.lit(0.0)).otherwise(price - F.lag(price).over(w)))
        out = out.withColumn("vol_delta", F.when(first, F.lit(0.0)).otherwise(F.col("volume") - F.lag("volume").over(w)))
        return out.withColumn("rolling_vol", F.stddev_pop("log_ret").over(w.rowsBetween(-self.vol_window, 0)))

    def on_block(self, block: Block) -> None:
        close, size = block.columns["close"], self.vol_window + 1
        block.columns["log_ret"] = changes(close, block, lambda x: np.log(np.where(x + LOG_EPS > 0, x + LOG_EPS, np.nan)))
        block.columns["vol_delta"] = changes(block.columns["volume"], block, lambda x: x)
        ret, starts, length = block.columns["log_ret"], block.starts, block.length
        slid = isinstance(close, Sliding)

        def first_frames() -> np.ndarray:
            rows = ret.dense(starts, min(size, length) if slid else length)
            return np.stack([moments(rows[:, max(0, at - size + 1) : at + 1])[1] for at in range(rows.shape[1])], 1)

        def frames() -> tuple[np.ndarray, np.ndarray]:
            tails = moments(np.lib.stride_tricks.sliding_window_view(ret.values, size))[1]
            return np.append(np.full(size - 1, np.nan), tails), first_frames()

        # Frames that begin after a window's first row are the same for all windows.
        block.columns["rolling_vol"] = Headed(frames, starts, length) if slid and length > size else Dense(first_frames)


def changes(column: Sliding | Dense, block: Block, of) -> Sliding | Dense:
    """Differences of a function of a column from row to row, 0 in a window's first."""
    if isinstance(column, Sliding) and column.first is None:
        x = of(column.values)
        return Sliding(np.append(0.0, np.diff(x)), 0.0)
    x = of(column.dense(block.starts, block.length))
    return Dense(np.concatenate([np.zeros((len(x), 1)), np.diff(x, axis=1)], 1))


class VwapFeatures(Transform):
    """close + 3 and volume + 1, each with seeded noise, and the running volume-weighted mean of close."""

    def __init__(self, noise_std: float = 0.1, seed: int = 42, keys: Sequence[str] = KEYS) -> None:
        self.noise_std, self.seed, self.keys = noise_std, seed, keys

    def apply(self, df: DataFrame) -> DataFrame:
        keys = [F.col(k) for k in (*self.keys, "pos") if k != "block"]  # a window's block may change
        noise = lambda k: normal(self.seed, k, keys) * F.lit(self.noise_std) if self.noise_std else F.lit(0.0)
        out = df.withColumn("close", F.col("close") + 3.0 + noise(0)).withColumn("volume", F.col("volume") + 1.0 + noise(1))
        return vwap(out, self.keys)

    def on_block(self, block: Block) -> None:
        for k, (name, more) in enumerate((("close", 3.0), ("volume", 1.0))):
            column = block.columns[name]
            if self.noise_std:
                noise = normal_array(self.seed, k, block.keys()) * self.noise_std
                block.columns[name] = Dense(column.dense(block.starts, block.length) + more + noise)
            elif isinstance(column, Sliding) and column.first is None:
                block.columns[name] = Sliding(column.values + more)
            else:
                block.columns[name] = Dense(column.dense(block.starts, block.length) + more)
        close, volume = block.columns["close"], block.columns["volume"]
        if isinstance(close, Sliding) and isinstance(volume, Sliding) and not np.isnan(close.values + volume.values).any():
            middle, slid = close.values.mean(), np.lib.stride_tricks.sliding_window_view
            over = lambda v: slid((p := prefix(v))[1:], block.length)[block.starts] - p[block.starts][:, None]
            have = True if volume.values.all() else over(volume.values != 0) > 0
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = over((close.values - middle) * volume.values.astype(np.longdouble)) / over(volume.values) + middle
            block.columns["vwap"] = Dense(np.where(have, mean, np.nan).astype(np.float64))
        else:
            c, v = block.dense("close"), block.dense("volume")
            weight, some = np.nancumsum(v, axis=1), np.cumsum(~np.isnan(c * v), axis=1) > 0
            with np.errstate(invalid="ignore", divide="ignore"):
                block.columns["vwap"] = Dense(np.where((weight != 0) & some, np.nancumsum(c * v, axis=1) / weight, np.nan))


def vwap(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    run = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("vwap", F.try_divide(F.sum(F.col("close") * F.col("volume")).over(run), F.sum("volume").over(run)))


class Standardise(Transform):
    """Columns less their window's mean, over its deviation (1 where that is 0); moments are kept as columns."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str] = KEYS) -> None:
        self.columns, self.keys = tuple(columns), keys

    def apply(self, df: DataFrame) -> DataFrame:
        whole = W.partitionBy(*self.keys)
        missing = set(self.columns) - set(df.columns)
        if missing:
            raise KeyError(f"no columns {sorted(missing)}")
        moments = {f"{c}_mean": F.avg(c).over(whole) for c in self.columns} | {f"{c}_scale": F.stddev_pop(c).over(whole) for c in self.columns}
        out = df.withColumns(moments)
        out = out.withColumns({f"{c}_scale": F.when(F.col(f"{c}_scale") == 0, 1.0).otherwise(F.col(f"{c}_scale")) for c in self.columns})
        return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in self.columns})

    def invert(self, df: DataFrame) -> DataFrame:
        if not {f"{c}_{m}" for c in self.columns for m in ("mean", "scale")} <= set(df.columns):
            raise RuntimeError("these windows were not standardised: their moments are missing")
        out = df.withColumns({c: F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_mean") for c in self.columns})
        return out.drop(*(f"{c}_{m}" for c in self.columns for m in ("mean", "scale")))

    def on_block(self, block: Block) -> None:
        missing = set(self.columns) - set(block.columns)
        if missing:
            raise KeyError(f"no columns {sorted(missing)}")
        found = {c: block.moments(c) for c in self.columns}
        for c, (mean, scale) in found.items():
            scale = np.where(scale == 0, 1.0, scale)
            block.scalars |= {f"{c}_mean": mean, f"{c}_scale": scale}
            block.columns[c] = Dense((block.dense(c) - mean[:, None]) / scale[:, None])

    def off_block(self, block: Block) -> None:
        for c in self.columns:
            if f"{c}_mean" not in block.scalars:
                raise RuntimeError("these windows were not standardised: their moments are missing")
            mean, scale = block.scalars.pop(f"{c}_mean"), block.scalars.pop(f"{c}_scale")
            block.columns[c] = Dense(block.dense(c) * scale[:, None] + mean[:, None])


class Pipeline(Transform):
    """Steps one after another; the inverse goes back through them."""

    def __init__(self, steps: Sequence[Transform]) -> None:
        self.steps = list(steps)

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(s.apply), self.steps, df)

    def invert(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(s.invert), reversed(self.steps), df)

    def on_block(self, block: Block) -> None:
        for s in self.steps:
            s.on_block(block)

    def off_block(self, block: Block) -> None:
        for s in reversed(self.steps):
            s.off_block(block)


def standardisation(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per window the mean and population deviation of each column, to check scaling with."""
    return df.groupBy(*keys).agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s") for c in columns))
