"""The pipeline's stages, each on a small input of its own and all together against their operators."""

import hashlib

import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from barlane.llm import common, op05_jaccard, op07_quality, registry


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edge_and_empty_documents(spark, sf_dir, docs, empty, k):
    _, stage = cp.STAGES[k]
    for df in (docs, empty):
        got = stage(spark, df, sf_dir)
        if k < 4:
            assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
        n = got.count()
        assert n <= df.count()
        if k in (1, 4):
            assert n == df.count()


def test_line_dedup_stage_changes_texts(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in cp.line_dedup(spark, docs, sf_dir).where("doc_id BETWEEN 10 AND 17").collect()}
    for i in range(10, 17):
        assert "stands in very many" not in got[i]["text"].lower()
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert "stands in very many" in got[17]["text"].lower()
    assert cp.line_dedup(spark, docs, sf_dir).where("doc_id = 3").first()["text"] is None


def test_whole_run_matches_its_stages(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents")
    labels, bench = common.load(spark, sf_dir, "labels"), common.load(spark, sf_dir, "benchmark")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = {r["doc_id"] for r in op07_quality.rank(docs, op07_quality.learn(docs, labels)).where("predicted = 1").collect()}
    rows = [(i, texts[i]) for i in sorted(good)]
    from test_op04_line_dedup import LOWER, SPACE

    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            k = line.strip(SPACE).translate(LOWER)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    stays = lambda i, line: not (len(h := holders.get(line.strip(SPACE).translate(LOWER), ())) >= 3 and i != max(h))
    rows = [(i, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows]

    from test_op05_jaccard import brute as components

    keep = {i for i, n, c in components(rows, op05_jaccard.Rule(5, 80, 100)) if n == 0 or i == c}
    rows = [(i, t) for i, t in rows if str(i) in keep]

    from test_op09_decontaminate import brute as leaks

    bad = {d for d, *_ in leaks(rows, [(r["item_id"], r["text"]) for r in bench.collect()])}
    rows = [(i, t) for i, t in rows if str(i) not in bad]

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest()) for i, t in rows)
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in cp.run(spark, sf_dir).collect())
    assert got == want
    assert 0 < len(got) < len(texts)
    assert docs.where(F.col("doc_id").isin([i for i, _ in got])).count() == len(got)
