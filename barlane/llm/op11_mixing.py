"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

1. A source's target is its weight times a common level, but at most MOST times its size. Sources above that are clamped, and
   what they can't take goes to the others by weight, again and again until none is above. A round is one row of sums.
2. A target is a number of whole repetitions of its source and a rest. Whole repetitions take every document.
3. For the rest, documents stand in the order of a seeded hash and are taken until it is filled: the one where it ends is taken if
   at least half of it fits. So a source's words miss its target by half a document at most.
4. That place is found without sorting a source: sizes are added up by the first digits of the hash, as many as make about the
   square root of its documents; only the bucket where the rest ends is looked into. Identical rows are one entry there, and their
   copies are numbered part by part, so no task holds a source, a bucket of it beyond that root, or all copies of a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlane.llm import common

#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, in sizes of all documents.
SHARE = 1.5
#: Epochs of a source at most.
MOST = 2
SEED = 11
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A document's place among those of its source, as hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def weighted(sources: DataFrame, weights: Sequence[float] | DataFrame) -> DataFrame:
    """`sources` with a column weight: that of a table (source, weight), 0 where it has none, or those of a sequence, in
    order of the sources' code points, null last, repeating. Sources are numbered part by part of a sorted table."""
    if isinstance(weights, DataFrame):
        given = weights.groupBy(F.col("source").alias("given")).agg(F.max("weight").cast("double").alias("weight"))
        return sources.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, "weight")
    order = F.col("source").asc_nulls_last()
    parts = common.written(sources.orderBy(order).withColumn("part", F.spark_partition_id()), "mix-order")
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_part"))
    before = before.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return parts.join(before, "part").withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int"))).drop("part", "before")


def water_fill(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size, weight) with a column target (double).

    Targets are in proportion to weights, add up to `share` times all sizes, and are at most `most` times a source's size; they
    add up to less only where all sources of a positive weight are clamped. Weights of 0 and sizes of 0 have the target 0.
    """
    cap, level, clamped = F.col("source_size") * most, 0.0, -1
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, full = share * (total or 0), 0
    while free:
        level = (budget - full * most) / free
        above = cap <= F.col("weight") * level
        n, full, free = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped:
            break
        clamped = n
    else:
        level = math.inf
    target = F.when((F.col("weight") <= 0) | (F.col("source_size") == 0), 0.0).otherwise(F.least(cap.cast("double"), F.col("weight") * level))
    return sources.withColumn("target", target)


def fractions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source its whole repetitions and the entry where its rest ends: edge_u and edge_size, null if it takes all documents
    once more, the number `copies` of rows with these and how many of them to take."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("digits", F.ceil(F.log(16.0, F.col("n_rows")) / 2).cast("int"))
    mine = F.col("source").eqNullSafe(F.col("of"))
    keys = sources.select(F.col("source").alias("of"), "digits")
    bucket = F.col("u").substr(F.lit(1), F.col("digits"))
    sums = rows.join(keys, mine).groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))

    def ends(df: DataFrame, words: str, *order: str) -> DataFrame:
        """The rows of df, one a source, where the rest ends, with the words before them."""
        w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("before", F.sum(words).over(w) - F.col(words))
        goals = sources.select(F.col("source").alias("of"), "rest", "digits")
        return df.join(goals, mine).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col(words))).drop("of")

    edges = common.written(ends(sums, "words", "bucket").select(F.col("source").alias("of"), "digits", F.col("bucket").alias("edge"), F.col("before").alias("earlier")), "mix-edges")
    inside = rows.join(edges, mine & (bucket == F.col("edge"))).groupBy("source", "u", "size", "earlier").agg(F.count(F.lit(1)).alias("copies"))
    inside = inside.withColumn("words", F.col("copies") * F.col("size"))
    w = Window.partitionBy("source").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("before", F.sum("words").over(w) - F.col("words") + F.col("earlier"))
    found = inside.join(sources.select(F.col("source").alias("of"), "rest"), mine)
    found = found.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    found = found.select("of", F.col("u").alias("edge_u"), F.col("size").alias("edge_size"), "copies", F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5).alias("takes"))
    return sources.join(found, mine, "left").drop("of", "rest", "digits")


def mix(docs: DataFrame, size: Column, weights: Sequence[float] | DataFrame = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, source) with a struct column `mix`: size, source_size, target and times, how often the mix takes the row.
    All columns stay; one that is called mix gives way.

    `size` is a column of docs, null for 0. A null source is a source of its own, the last one; a null doc_id is drawn like a number. Rows
    without size are taken 0 times, and so are those of a source with no weight. Repeated rows count each; where the rest
    ends among rows of one doc_id and size, that many of them are taken, which ones is open. The same rows give the same
    result however they are dealt. An empty table gives none. `docs` is written to the shared folder once, so leave out what you don't need.
    """
    spark = docs.sparkSession
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "mix"))
    rows = docs.select(kept.alias("row"), F.col("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), draw(F.col("doc_id"), seed).alias("u"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = common.written(rows, "mix-rows")
    with common.workspace(spark, "mix") as keep:
        sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
        sources = common.written(weighted(common.written(sources, "mix-sizes"), weights), "mix-weights")
        plan = keep(fractions(rows, water_fill(sources, share, most)), "mix-plan")
    joined = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    edge = (F.col("u") == F.col("edge_u")) & (F.col("size") == F.col("edge_size"))
    earlier = F.col("edge_u").isNull() | (F.col("u") < F.col("edge_u")) | ((F.col("u") == F.col("edge_u")) & (F.col("size") < F.col("edge_size")))
    many = F.coalesce(edge & (F.col("copies") > 1), F.lit(False))
    one = joined.where(~many).withColumn("extra", F.when(earlier, 1).when(edge, F.col("takes")).otherwise(0))
    copies = joined.where(many)
    parts = copies.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n_part"))
    parts = parts.select(F.col("of").alias("of2"), F.col("part").alias("part2"), (F.sum("n_part").over(Window.partitionBy("of").orderBy("part")) - F.col("n_part")).alias("before"))
    number = F.row_number().over(Window.partitionBy("of", "part").orderBy("at")) + F.col("before")
    copies = copies.join(parts, F.col("of").eqNullSafe(F.col("of2")) & (F.col("part") == F.col("part2"))).withColumn("extra", F.when(number <= F.col("takes"), 1).otherwise(0))
    out = one.unionByName(copies.drop("of2", "part2", "before"))
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int")
    return out.select("row.*", F.struct("size", "source_size", "target", times.alias("times")).alias("mix"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of mix() as often as it takes them, without the column mix."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("mix.times"))).alias("again")
    return mixed.select("*", times).drop("again", "mix")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents. times is the number of repetitions of the row."""
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    got = mix(docs, F.col("size"))
    return got.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.times")).alias("taken"), "mix.times")


SQL = rf"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
    FROM docs GROUP BY source
), filled AS (
    SELECT *, ({SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER earlier, 0)) / sum(weight) OVER later AS level
    FROM sources
    WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), leveled AS (
    SELECT source, source_size, weight, max(level) OVER () AS level FROM filled
), targets AS (
    SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), weight * level) AS target FROM leveled
), placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS INTEGER) ELSE 0 END AS whole,
           CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
    SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN before <= target - whole * source_size AND floor((target - whole * source_size - before) / size + 0.5) >= 1 THEN 1 ELSE 0 END END AS times FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * times AS BIGINT) AS taken, times FROM taken
"""
