import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlane.llm import common, op06_language as op


def test_held_out_accuracy(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents")
    got = op.op6_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_documents(docs, doc_rows):
    got = op.predict(docs, op.learn(docs)).collect()
    assert len(got) == len(doc_rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {3, 4, 5}


def test_labels_of_held_out_rows_do_not_matter(docs):
    held = common.held_out_col(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = op.learn(docs), op.learn(other)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_empty(empty, docs):
    assert op.learn(empty) == {}
    assert op.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in op.predict(docs, {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    s = op.Space(64, 1)
    letters = np.random.default_rng(1).choice(np.array([-1, 1], np.int8), (op.LETTERS, 64)).astype(int)
    codes = s.letters("Ab-- é!")
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert (s.bundle("Ab-- é!") == want).all()
    assert (codes[[0, 3, 5]] == 0).all() and len(codes) == 6
    assert s.bundle("12 !?") is None


@pytest.mark.parametrize("text", ["\U00010400\U00010428 x", "日本語", "a" * 10_000])
def test_letters_of_all_planes(text):
    assert op.space().bundle(text) is not None


def test_every_letter_has_a_vector_of_its_own():
    s = op.Space(512, 3)
    points = [c for c in [*range(97, 123), *range(0xDF, 0x180), *range(0x3B1, 0x460), *range(0x4E00, 0x4F00), *range(0x10428, 0x10440)] if chr(c).isalpha() and chr(c).lower() == chr(c)]
    codes = np.array([s.letters(chr(c))[1] for c in points])
    assert len(points) > 500 and len(set(codes.tolist())) == len(points)
    v = s.vectors(codes).astype(int)
    assert np.abs(v @ v.T - 512 * np.eye(len(v))).max() < 200
    assert (s.bundle("äöü") != s.bundle("öüä")).any() and (s.bundle("ä") != s.bundle("ê")).any()


def test_scripts_that_differ_by_code_points_only(make_docs, spark):
    # the same words in three alphabets whose code points differ by multiples of 21
    rng = np.random.default_rng(6)
    words = ["".join(chr(0x4E00 + k) for k in rng.integers(0, 12, 5)) for _ in range(30)]
    moved = lambda t, by: "".join(chr(ord(c) + by) if c != " " else c for c in t)
    rows = [(3 * i + j, moved(" ".join(rng.choice(words, 20)), 21 * j), f"l{j}") for i in range(60) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in op.predict(docs, op.learn(docs)).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 10 and all(got[i]["lang_pred"] == f"l{i % 3}" for i in held)


def test_query_matches_brute_force(spark, sf_dir):
    rows = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    s = op.Space()

    def vector(text):
        codes = s.letters(text)
        v = s.vectors(codes).astype(float)
        return (np.roll(v[:-2], 2, 1) * np.roll(v[1:-1], 1, 1) * v[2:]).sum(0), Counter(zip(codes, codes[1:], codes[2:], strict=False))

    total = {}
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    made = {r["doc_id"]: vector(r["text"] or "") for r in rows}
    for r in rows:
        v, n = made[r["doc_id"]]
        if r["lang"] and n and not held(r):
            total[r["lang"]] = total.get(r["lang"], 0) + v / np.sqrt(sum(x * x for x in n.values()))
    got = {r["doc_id"]: r for r in op.op6_language(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        v, n = made[r["doc_id"]]
        cos = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in total.items()} if n else {"und": 0.0}
        best = max(sorted(cos), key=cos.get)
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - max(0, cos[best])) < 1e-4


def test_kept_vectors_are_those_that_are_bound(monkeypatch):
    texts = ["Über alte Brücken, señor", "привет мир 日本語 Ǆ", "ça été déjà vu", "Über señor été", "\U0001d11e ẞß"] * 2
    for most in (0, 3, op.MOST_OTHER):
        monkeypatch.setattr(op, "MOST_OTHER", most)
        s = op.Space()
        for t in texts:
            which, n = s.counts(t)
            want = np.zeros(s.dimensions)
            for g, k in zip(which.tolist(), n.tolist(), strict=True):
                base, g = (op.LETTERS, g - op.KEPT) if g >= op.KEPT else (op.LATIN, g)
                want += k * s.bound(*(np.array([x]) for x in (g // base**2, g // base % base, g % base)))[0]
            assert np.array_equal(s.bundle(t), want.astype(np.float32))
        assert len(s.other) <= most
