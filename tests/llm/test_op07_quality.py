import zlib

import numpy as np
from pyspark.sql import functions as F

from barlane.llm import common, op07_quality as op


def test_held_out_accuracy(spark, sf_dir):
    labels = common.load(spark, sf_dir, "labels")
    got = op.op7_quality(spark, sf_dir).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.85 * len(held)
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_edge_documents(spark, docs, doc_rows):
    labels = labels_of(spark, [(0, 1, 0), (1, 1, 0), (21, 0, 0), (22, 0, 1), (None, 1, 1), (2, None, None), (0, 0, 0), (99, 1, 0), (3, 1, 0)])
    got = op.rank(docs, op.learn(docs, labels)).collect()
    assert len(got) == len(doc_rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = op.keep_good(docs, op.learn(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_no_labels_rejects_nothing(spark, docs, empty, doc_rows):
    none = op.learn(docs, labels_of(spark, []))
    assert {r["score"] for r in op.rank(docs, none).collect()} == {0.5}
    assert op.keep_good(docs, none).count() == len(doc_rows)
    one = op.learn(docs, labels_of(spark, [(0, 1, 0)]))
    assert {r["predicted"] for r in op.rank(docs, one).collect()} == {1}
    assert op.rank(empty, none).count() == 0 and op.keep_good(empty, none).count() == 0


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", F.when(common.held_out_col(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = op.learn(docs, labels), op.learn(docs, flipped)
    x = np.array([op.features(t) for t in ("some words here", "A!! B!!", "")])
    assert np.allclose(a.score(x), b.score(x))


def test_pairs_order_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(op.features(""))))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > 0).astype(int)
    m = op.fit(x, y)
    s = m.score(x)
    assert ((s >= op.CUT) == y).mean() > 0.9
    assert abs(1 / (1 + np.exp(-np.log(op.CUT / (1 - op.CUT)))) - op.CUT) < 1e-12


def test_query_matches_brute_force(spark, sf_dir):
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    m = op.learn(docs, labels)
    got = {r["doc_id"]: r for r in op.op7_quality(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = 0.0
        for j, v in enumerate(op.features(r["text"] or "")):
            for k in range(m.knots.shape[1] - 1):
                low, high = m.knots[j, k], m.knots[j, k + 1]
                raw += m.weights[j * (m.knots.shape[1] - 1) + k] * min(1.0, max(0.0, (v - low) / max(high - low, 1e-9)))
        want = 1 / (1 + np.exp(-(raw - m.threshold) / m.scale - np.log(0.3 / 0.7)))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_model_does_not_follow_the_order_of_rows(spark, sf_dir):
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    a, b = op.learn(docs.repartition(1), labels), op.learn(docs.repartition(7).orderBy(F.desc("doc_id")), labels.repartition(3))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.knots, b.knots) and a.threshold == b.threshold


def test_weights_are_those_of_a_plain_solver():
    """The loss over all pairs, with its penalty, against Newton's method on the same features."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, len(op.features(""))))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=160) > 0).astype(int)
    m = op.fit(x, y)
    e = op.expand(x, m.knots)
    d = (e[y == 1][:, None] - e[y == 0][None]).reshape(-1, e.shape[1])
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + op.L2 / 2 * (w @ w)
    w = np.zeros(e.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        g = -(d * p[:, None]).mean(0) + op.L2 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + op.L2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    assert loss(w) <= loss(m.weights) <= loss(w) + 0.02
    assert np.corrcoef(e @ w, e @ m.weights)[0, 1] > 0.99
