"""Small tables with the cases that every operator must take: nulls, empty, very long, repeated and clashing."""

import random

import pytest
from pyspark.sql import types as T

WORDS = ["the", "river", "runs", "Über", "alte", "Brücken", "et", "la", "forêt", "señor", "lights", "over", "stone.", "quiet,", "hills", "12", "日本", "x|y", "a" * 45, "don't"]

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # Names that operators use inside, with other types.
    + [T.StructField(c, T.StringType()) for c in ("lang", "source", "n_tokens", "start", "score", "did", "th", "h", "n", "f1", "kind", "shard", "lines", "row", "label", "__drop", "line_dedup", "__did", "__th")]
    + [T.StructField("n_chars", T.LongType())]
)


def text(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + (rng.choice(["", "", "", str(rng.randrange(99))])))
        if rng.random() < 0.1:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


def rows():
    """(doc_id, text, lang)"""
    base = text(1, 120)
    near = base.replace("river", "RIVER", 1) + " end"
    shared = "This line stands in very many of the documents here."
    out = [(0, base, "en"), (1, base, "en"), (2, near, "de"), (3, None, "fr"), (4, "", "en"), (5, " \n\t ", "en"), (6, "word", None)]
    out += [(10 + i, f"{text(100 + i, 40)}\n  {shared.upper() if i % 2 else shared}\t\n{text(200 + i, 30)}", "en") for i in range(8)]
    out += [(20, text(3, 20_000), "es"), (21, "b" * 30_000, "en"), (22, "a b " * 5_000, "en")]
    out += [(30, base, "en"), (30, base, "en"), (30, text(5), "fr"), (None, base, "en"), (None, text(6), None), (-5, near + " more", "en")]
    out += [(40, "<|im_end|> \x00 ▁▁ x  y   \U0001d11e Ǆ İ ſ <s> <0x0A>\r\n\x0b\x0c 　z", "en")]
    return out


def filled(found):
    return [(i, t, lang, *["clash"] * 18, None if t is None else len(t)) for i, t, lang in found]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(filled(rows()), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda found: spark.createDataFrame(filled([(i, t, None) for i, t in found]), DOCS)
