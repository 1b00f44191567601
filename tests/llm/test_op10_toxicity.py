import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barlane.llm import common, labelled, op10_toxicity as op


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = common.load(spark, sf_dir, "labels")
    got = op.op10_toxicity(spark, sf_dir).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where(common.held_out_col(F.col("doc_id"))).collect()
    toxic, clean = ([r for r in got if r["y"] == y] for y in (1, 0))
    assert len(toxic) > 30
    assert sum(r["toxic"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.015 * len(clean)
    assert np.mean([r["expected_severity"] for r in toxic]) > 1 > np.mean([r["expected_severity"] for r in clean])


def test_edge_documents(spark, docs, doc_rows, empty):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, None), (10, 1, 0), (None, 1, 1), (3, 0, 1), (98, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = op.score(docs, op.learn(docs, labels)).collect()
    assert len(got) == len(doc_rows) and all(0 <= r["expected_severity"] <= 3 and 0 <= r["grade"] <= 3 for r in got)
    none = op.learn(docs, labels.limit(0))
    assert not any(r["toxic"] for r in op.score(docs, none).collect())
    assert op.score(empty, none).count() == 0


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (600, 3)).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0])
    grade = np.searchsorted([1.5, 4.0, 6.5], z)
    m = op.fit(("a", "b", "c"), x, grade)
    assert (np.diff(m.thresholds) > 0).all()
    assert m.weights[0] > m.weights[1] > abs(m.weights[2])
    expected = m.above(x @ m.weights).sum(1)
    assert abs(expected - grade).mean() < 0.4


def test_gradient_raises_the_likelihood():
    x = np.array([[0.0], [0.0], [1.0], [2.0], [3.0]])
    grade = np.array([0, 0, 1, 2, 3])
    m = op.fit(("a",), x, grade)
    above = m.above(x @ m.weights)
    each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], 1)
    assert (each.argmax(1) == grade).all()


def test_grades_are_terciles_with_ties():
    y = np.array([0, 1, 1, 1, 1, 1, 1, 0])
    assert op.grades(y, np.array([9, 1, 2, 3, 4, 5, 6, 0.5])).tolist() == [0, 1, 1, 2, 2, 3, 3, 0]
    assert op.grades(y, np.full(8, 0.25)).tolist() == [0, 2, 2, 2, 2, 2, 2, 0]
    assert op.grades(np.zeros(3, int), np.zeros(3)).tolist() == [0, 0, 0] and op.grades(np.zeros(0, int), np.zeros(0)).tolist() == []


def test_query_matches_brute_force(spark, sf_dir):
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    m = op.learn(docs, labels)
    got = {r["doc_id"]: r for r in op.op10_toxicity(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = Counter(f for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)])
        z = sum(w * np.log1p(n[f]) for f, w in zip(m.features, m.weights, strict=True))
        above = 1 / (1 + np.exp(m.thresholds - z))
        assert abs(got[r["doc_id"]]["expected_severity"] - above.sum()) < 1e-6
        assert abs(got[r["doc_id"]]["p_toxic"] - above[0]) < 1e-6 and got[r["doc_id"]]["grade"] == np.argmax([1 - above[0], *(above[:-1] - above[1:]), above[-1]])


def test_labels_of_documents_that_are_not_there_take_no_place(spark, make_docs):
    docs = make_docs([(i, f"text {i} {'vile' if i % 2 else 'nice'}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(-2000, 40)], "doc_id long, toxic int")
    kept = labelled.sample(docs, labels, "toxic", 12, "t").collect()
    assert sum(r["y"] for r in kept) == 12 and len(kept) == 24


def test_word_features():
    assert op.word_features("worthless") == ["worthless", "wort*", "worth*", "worthl*"]
    assert op.word_features("ab") == ["ab"]
    model = op.Ordinal(("bad", "wors*"), np.array([1.0, 2.0]), np.array([1.0, 2.0, 3.0]))
    assert dict(op.Scorer(model).counts("Bad, bad worse WORST-bad x")) == {0: 3, 1: 2}


def test_weights_are_those_of_a_plain_solver():
    """The loss of learned weights and thresholds against plain descent by differences."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    grade = np.clip(np.digitize(x @ [1.5, -1.0, 0.0] + rng.logistic(size=300), [0.5, 1.5, 2.5]), 0, 3)
    m = op.fit(("a", "b", "c"), x, grade)
    balance = np.where(grade == 0, 0.5 / (grade == 0).sum(), 0.5 / (grade > 0).sum())

    def loss(p):
        cut = np.concatenate([[-np.inf], p[3] + np.concatenate([[0.0], np.exp(p[4:]).cumsum()]), [np.inf]])
        f = 1 / (1 + np.exp(-(cut[None] - (x @ p[:3])[:, None])))
        prob = f[np.arange(300), grade + 1] - f[np.arange(300), grade]
        return -(balance * np.log(np.maximum(prob, 1e-12))).sum() + op.L2 / 2 * (p[:3] @ p[:3])

    p, step = np.array([0, 0, 0, 1.0, 0, 0]), 1.0
    for _ in range(1500):
        g = np.array([(loss(p + d) - loss(p - d)) / 2e-5 for d in np.eye(6) * 1e-5])
        while loss(p - step * g) > loss(p) - 1e-4 * step * (g @ g) and step > 1e-9:
            step /= 2
        p, step = p - step * g, step * 1.5
    mine = np.concatenate([m.weights, m.thresholds[:1], np.log(np.diff(m.thresholds))])
    assert loss(p) - 1e-6 <= loss(mine) <= loss(p) + 0.01
    assert np.allclose(m.weights, p[:3], atol=0.1) and (np.diff(m.thresholds) > 0).all()


def test_model_does_not_follow_the_order_of_rows(spark, sf_dir):
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    a, b = op.learn(docs.repartition(1), labels), op.learn(docs.repartition(5), labels)
    assert a.features == b.features and np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)
    assert len(op.learn(docs, labels, most=4).features) <= 4
