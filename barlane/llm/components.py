"""Connected components of links, by alternating large-star and small-star steps on DataFrames.

Before each pair of steps every task joins up its own links (a bounded number at a time), which shortens long paths.
A step takes the smallest neighbour of every node (counted in the tasks first) and joins it back to the node's links,
so no node's neighbours are gathered; a hub's links are a skewed join, which Spark splits. It is over when every link
leads from a node to its component's smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlane.llm import common

MOST_STEPS = 60
#: Links that a task joins up together.
TOGETHER = 400_000
BATCH_ROWS = 20_000


def _joined_up(edges: DataFrame) -> DataFrame:
    """The same components with fewer, shorter paths: links from nodes to the smallest one that a task can reach."""

    def stars(links: list[tuple]) -> pa.RecordBatch:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            path = []
            while (y := top.setdefault(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                top[p] = x
            return x

        for u, v in links:
            a, b = find(u), find(v)
            if a != b:
                top[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(top) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= TOGETHER:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return common.map_arrow(edges, run, "u long, v long")


def _over(edges: DataFrame) -> bool:
    """Whether every node has one link, and none leads to a node that has one itself."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").unionAll(twice).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b: long); the label is the component's smallest node.

    Links of a node with itself, repeated links and empty tables are fine; a link with a null end is no link.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(MOST_STEPS):
        edges = common.written(_joined_up(edges), "cc", BATCH_ROWS)
        if _over(edges):
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.written(large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = common.written(small.where("u <> v").distinct(), "cc")
        if _over(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
