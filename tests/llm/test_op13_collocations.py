import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from barlane.llm import op13_collocations as op


def brute(rows, least, longest, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in found.items():
        if any(x == lang and len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for (x, h), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        of = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(of[:top], 1)]
    return sorted(ranked)


def found(docs, **kw):
    return sorted(tuple(r) for r in op.collocations(docs, **kw).collect())


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 10**6), (8, 5, 40), (4, 3, 10**6), (2, 2, 25)])
def test_is_brute_force(docs, doc_rows, least, longest, top):
    rows = [(lang, text) for _, text, lang in doc_rows if len(text or "") < 50_000 or least > 3]
    use = docs if len(rows) == len(doc_rows) else docs.where("text is null or length(text) < 50000")
    want = brute(rows, least, longest, top)
    assert found(use, least=least, longest=longest, top=top) == want and len(want) > 5


def test_hot_pivots_are_dealt_and_added_up(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [("en" if i % 3 else None, " ".join(rng.choice(["the", "of", "to", "a b", f"w{rng.randrange(9)}", "x."]) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 6, 5, 500)
    assert found(docs, least=6, top=500) == want
    monkeypatch.setattr(op, "MINE_ROWS", 64)
    table = spark.sparkContext.broadcast(op.slots(op.counted(docs, 0).where("n >= 6")))
    once = {tuple(r["phrase"]): r["a"] for r in op.mined(op.fragments(docs, table, 5, 0, 3), 6, 5, 3).collect()}
    monkeypatch.setattr(op, "PIVOT_ROWS", 7)
    dealt = op.fragments(docs, table, 5, 0, 40)
    assert any(1 in r["shape"][2::3] for r in dealt.collect())
    assert {tuple(r["phrase"]): r["a"] for r in op.mined(dealt, 6, 5, 40).collect()} == once and len(once) > 50


def test_words_that_share_a_slot_change_nothing(docs, doc_rows, monkeypatch):
    rows = [(lang, text) for _, text, lang in doc_rows if len(text or "") < 50_000]
    use = docs.where("text is null or length(text) < 50000")
    monkeypatch.setattr(op, "slots", lambda words: np.full(op.SLOTS, 50, np.uint32))
    assert found(use, least=3) == brute(rows, 3, 5, op.TOP)


def test_words_that_share_a_hash_take_another_seed(docs, monkeypatch):
    want = found(docs, least=8)
    real, asked = op.counted, []

    def counted(rows, seed):
        from pyspark.sql import functions as F

        asked.append(seed)
        return real(rows, seed) if seed else real(rows, seed).withColumn("h", F.lit(5).cast("long"))

    monkeypatch.setattr(op, "counted", counted)
    assert found(docs, least=8) == want and asked == [0, 1]


def test_equal_rows_even_where_hashes_agree(monkeypatch):
    rows = np.random.default_rng(1).integers(0, 3, (500, 3)).astype(np.uint64)
    for mixed in (op.mix, lambda x: x * np.uint64(0)):
        monkeypatch.setattr(op, "mix", mixed)
        order, begin = op.same_rows(rows)
        n = np.diff(np.append(begin, 500))
        got = {tuple(rows[order[b]]): c for b, c in zip(begin, n.tolist(), strict=True)}
        assert got == Counter(map(tuple, rows))


def test_large_numbers_are_exact(spark):
    phrases = spark.createDataFrame([([1, 2], 3 * 10**15 + 1)], "phrase array<long>, a long")
    words = spark.createDataFrame([("x", "p", 1, 10**16 + 7), ("x", "q", 2, 9 * 10**15)], "lang string, word string, h long, n long")
    totals = spark.createDataFrame([("x", 10**17 + 3)], "lang string, n long")
    row = op.scored(phrases, words, totals).first()
    assert row["score"] == 1000 * (3 * 10**15 + 1) * (10**17 + 3) // ((10**16 + 7) * 9 * 10**15)


def test_empty(spark, empty):
    assert found(empty) == []
    assert found(spark.createDataFrame([(None, None), ("en", ""), ("en", " .,\n")], "lang string, text string"), least=1) == []


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(op.SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, op.op13_collocations(spark, sf_dir).select(*names).collect())) == sorted(want)
