"""Seeded noise that depends on nothing but the seed and a row's keys: the same under any partitioning and at every retry.

A row's counter is the xxHash64 of seed, stream and keys; two of them give a normal number (Box and Muller). The same numbers are
made as columns and in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The primes of xxHash64, and the seed that Spark's function starts from.
PRIMES = tuple(np.array([11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261], np.uint64))
START = 42


def _unit(h: Column) -> Column:
    """A hash as a number between 0 and 1, neither included."""
    return (F.shiftrightunsigned(h, 11) + 0.5) / F.lit(2.0**53)


def normal(seed: int, stream: int, keys: Sequence[Column]) -> Column:
    """Normal numbers by the keys, which are whole numbers."""
    h = [F.xxhash64(F.lit(seed).cast("long"), F.lit(2 * stream + k).cast("long"), *(c.cast("long") for c in keys)) for k in (0, 1)]
    return F.sqrt(-2 * F.ln(_unit(h[0]))) * F.cos(2 * math.pi * _unit(h[1]))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashed(values: Sequence[np.ndarray | int]) -> np.ndarray:
    """xxHash64 of rows of 64-bit numbers, each hashed with the hash before it as its seed."""
    p1, p2, p3, p4, p5 = PRIMES
    h = np.array(START, np.uint64)
    with np.errstate(over="ignore"):
        for v in values:
            h = h + p5 + np.uint64(8)
            h = h ^ (_turn(np.asarray(v, np.int64).view(np.uint64) * p2, 31) * p1)
            h = _turn(h, 27) * p1 + p4
            h = (h ^ (h >> np.uint64(33))) * p2
            h = (h ^ (h >> np.uint64(29))) * p3
            h = h ^ (h >> np.uint64(32))
    return h


def normal_array(seed: int, stream: int, keys: Sequence[np.ndarray | int]) -> np.ndarray:
    """normal() in numpy; keys are broadcast."""
    unit = lambda h: ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    a, b = (unit(hashed([seed, 2 * stream + k, *keys])) for k in (0, 1))
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
