"""Bounded samples of labelled documents, for the operators that learn from `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlane.llm import common


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, name: str) -> DataFrame:
    """(text, y, doc_id, th) of up to `per_class` documents with label 1 and as many with label 0, of those that are not held out.

    The choice is by the hash of doc_id among the labelled documents that `docs` has with a text, so it is the same at every
    run and labels of other documents take no place in it. A null label, doc_id or text leaves a row out; a doc_id with
    several labels counts with the smallest. At most 2 * per_class doc_ids go to the driver and are broadcast, which
    bounds both; th is the hash of the text, by which and by doc_id the rows have an order. Their documents are written to the shared folder once. Of documents that repeat a doc_id all count.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out_col(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    rows = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    ids = spark.createDataFrame(chosen, "doc_id long, y int")
    found = texts.join(F.broadcast(ids), "doc_id")
    return common.written(found.select("text", "y", "doc_id", F.xxhash64("text").alias("th")), name)
