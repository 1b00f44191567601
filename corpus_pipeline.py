"""The corpus pipeline: rejects bad documents, drops repeated lines, keeps one of near duplicates, removes documents
that hold benchmark items, and encodes what is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common, op03_sentencepiece, op04_line_dedup, op05_jaccard, op07_quality, op09_decontaminate

#: Near duplicates of the pipeline: five-word shingles, similarity 0.8.
NEAR = op05_jaccard.Rule(5, 80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking, learned from labels, accepts. Rows without a score to reject them stay."""
    return op07_quality.keep_good(docs, op07_quality.learn(docs, common.load(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated lines dropped from their texts; n_chars follows the text.

    A null text stays null. A document whose lines all go stays, with an empty text.
    """
    [name] = common.fresh(docs, "line_dedup")
    got = op04_line_dedup.dedup(docs, name=name)
    text = F.when(F.col("`text`").isNull(), F.col("`text`")).otherwise(F.col(f"{name}.kept_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{name}.n_dropped") > 0, F.length(f"{name}.kept_text")).otherwise(F.col("`n_chars`")).cast(docs.schema["n_chars"].dataType)
    return got.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest doc_id; of repeated rows of that, one."""
    return op05_jaccard.keep_one(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op09_decontaminate.clean(docs, common.load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, and digests of its ids and of the text they decode to."""
    return op03_sentencepiece.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: the classifier and the encoder can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over all documents, each stage's rows written and read again."""
    docs = common.load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{k}")
    return docs
