import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from barlane.llm import common, op05_jaccard as op, shingles

SPACE = common.SPACE


def sets(rows, size):
    out = []
    for _, t in rows:
        w = shingles.words(t or "")
        k = min(size, len(w))
        out.append(set(zip(*(w[i : len(w) - k + 1 + i] for i in range(k)), strict=True)) if w else set())
    return out


def brute(rows, rule):
    s = sets(rows, rule.size)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and rule.den * len(s[i] & s[j]) >= rule.num * len(s[i] | s[j]):
                top[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return sorted((str(d), len(s[i]), str(groups.get(find(i)) if s[i] else d)) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def corpus(seed, n=250, longest=80):
    """Texts in families of edits of edits, so that links form chains, and many tiny texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = rng.choice(vocabulary)
                else:
                    w.insert(at, rng.choice(vocabulary))
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, longest))]
        texts.append(" ".join(w))
    return [(i * 3 % 997, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rule", [op.Rule(3, 90, 100), op.Rule(5, 80, 100), op.Rule(1, 60, 100)])
def test_families(make_docs, rule):
    rows = corpus(rule.size)
    assert found(op.near_duplicates(make_docs(rows).repartition(3), rule)) == brute(rows, rule)


@pytest.mark.parametrize("light", [0, 9, 30, 10**9])
def test_any_boundary_gives_the_same(make_docs, monkeypatch, light):
    monkeypatch.setattr(op, "boundary", lambda *_: light)
    monkeypatch.setattr(op, "PART", 4)
    monkeypatch.setattr(op, "REPORTED", 2)
    rows = corpus(11, 160, 50)
    assert found(op.near_duplicates(make_docs(rows).repartition(2), op.Rule())) == brute(rows, op.Rule())


def test_edge_documents(docs, doc_rows):
    rows = [(i, t) for i, t, _ in doc_rows]
    assert found(op.near_duplicates(docs, op.Rule())) == brute(rows, op.Rule())


def test_empty(empty):
    assert op.near_duplicates(empty, op.Rule()).count() == 0
    assert op.keep_one(empty, op.Rule()).count() == 0


def test_keep_one(docs, doc_rows):
    kept = op.keep_one(docs, op.Rule())
    assert kept.columns == docs.columns
    rows = [(i, t) for i, t, _ in doc_rows]
    want = {c for _, n, c in brute(rows, op.Rule()) if n}
    got = kept.collect()
    full = [str(r["doc_id"]) for r in got if shingles.words(r["text"] or "")]
    assert len(full) == len([1 for _ in set(full)]) + (full.count("30") - 1 if "30" in full else 0)
    assert want <= set(full) | {"None"}
    assert sum(not shingles.words(r["text"] or "") for r in got) == 3
    assert "1" not in full and "0" not in full  # copies of -5's family


def test_boundary_follows_cost():
    rule = op.Rule()
    sizes = [(n, 10) for n in range(9, 400)]
    assert op.boundary(sizes, 0.0, 0.0, rule) < op.boundary(sizes, 0.0, 50.0, rule)
    assert op.boundary(sizes, 50.0, 50.0, rule) < op.boundary(sizes, 0.0, 50.0, rule)
    assert op.boundary([], 1.0, 1.0, rule) == 0


def test_subsets_win_where_they_cost_less(make_docs, monkeypatch):
    """Short texts of few words: each shingle is in very many of them, each pair of shingles in few."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(30, 40)))) for i in range(900)]
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    rows += [(3000 + i, t + " a") for i, (_, t) in enumerate(rows[40:90])]
    chosen, real = [], op.boundary
    monkeypatch.setattr(op, "boundary", lambda *a: chosen.append(real(*a)) or chosen[-1])
    rule = op.Rule(5, 80, 100)
    assert found(op.near_duplicates(make_docs(rows).repartition(3), rule, None)) == brute(rows, rule)
    sizes = [len(s) for s in sets(rows, 5)]
    assert chosen[0] > 0 and sum(n <= chosen[0] for n in sizes) > 100


def test_the_cap_on_subsets_is_a_parameter():
    rule = op.Rule(5, 80, 100)
    sizes = [(n, 1) for n in range(6, 3000)]
    light = op.boundary(sizes, 0.0, 1e9, rule, None)
    assert light == 2999 and op.subsets(light, rule) > 10_000
    assert op.subsets(op.boundary(sizes, 0.0, 1e9, rule), rule) <= op.MOST_SUBSETS


def test_links_query_is_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(op.SQL_LINKS).fetchall()
    names = [c[0] for c in con.description]
    got = op.op5_jaccard_links(spark, sf_dir)
    assert set(got.columns) == set(names) and sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_prefixes_are_complete():
    rule = op.Rule()
    for n in range(1, 60):
        for m in range(n, 70):
            shared = -(-rule.num * (n + m) // (rule.num + rule.den))
            if shared <= min(n, m) and (n, m) != (n, n) or n == m:
                assert n + m - 2 * shared == rule.most_apart(np.array([n + m]))[0]
                if shared <= n and not rule.lonely(n):
                    assert rule.prefix(n) >= n - shared + 1 and rule.prefix(m) >= m - shared + 1
    assert rule.lonely(8) and not rule.lonely(9)


def test_bound_never_exceeds_the_truth():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**48, 9000).astype(np.uint64)
    some = [np.unique(rng.choice(pool, n, replace=False)) for n in (5, 300, 900, 1200, 4000, 5000)]
    sizes = [op.buckets(len(s), op.Rule()) for s in some]
    counts = [np.minimum(np.bincount((s % np.uint64(b)).astype(int), minlength=b), 255).astype(np.int16) for s, b in zip(some, sizes, strict=True)]
    rows = np.arange(len(some))
    low = op.apart_at_least(counts, rows, np.zeros((len(some), len(some)), int))
    for i in rows:
        for j in rows:
            if low[i, j] < 2**40:
                assert low[i, j] <= len(np.setxor1d(some[i], some[j]))


def test_sets_that_share_half_a_fingerprint_get_names_of_their_own(spark):
    sets = spark.createDataFrame([(1, 5, 50), (2, 5, 50), (3, 5, 51), (4, 6, 50), (5, 5, 52)], "did long, f1 long, f2 long")
    name = {r["did"]: r["f1"] for r in op.told_apart(sets).collect()}
    assert name[1] == name[2] and name[4] == 6
    assert len({name[d] for d in (1, 3, 4, 5)}) == 4


def test_entries_are_counted_before_they_are_made(make_docs):
    rule = op.Rule()
    sets = op.told_apart(op.hashed_sets(make_docs(corpus(3, 80)).coalesce(1), rule).where("kind = 0"))
    sizes = [(r["n"], r["c"]) for r in sets.where("n > 0").groupBy("n").agg(F.count_distinct("f1").alias("c")).collect() if not rule.lonely(r["n"])]
    for light in (0, 30, 10**9):
        assert op.list_entries(sets, np.empty(0, np.uint64), light, rule).count() == op.entries_of(sizes, light, rule)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in common.load(spark, sf_dir, "documents").collect()]
    assert found(op.op5_jaccard(spark, sf_dir)) == brute(rows, op.Rule())


def brute_links(rows, rule):
    s = sets(rows, rule.size)
    linked = lambda a, b: a and b and rule.den * len(a & b) >= rule.num * len(a | b)
    return sorted((str(d), sum(bool(linked(s[i], s[j])) for j in range(len(rows)) if j != i)) for i, (d, _) in enumerate(rows))


def links_found(df):
    return sorted((str(r["doc_id"]), r["n_links"]) for r in df.collect())


@pytest.mark.parametrize("rule", [op.Rule(3, 90, 100), op.Rule(1, 60, 100)])
def test_links_inside_dense_components_count(make_docs, monkeypatch, rule):
    monkeypatch.setattr(op, "PART", 16)
    base = [f"w{i}" for i in range(150)]
    near = [(2000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    rows = corpus(7, 120) + near + near[:3] + [(5000, None), (None, near[0][1])]
    got = op.link_counts(make_docs(rows).repartition(3), rule)
    assert links_found(got) == brute_links(rows, rule)
    assert max(n for _, n in brute_links(rows, rule)) >= 40
    assert found(got) == brute(rows, rule)


def test_links_of_edge_documents(docs, doc_rows, empty):
    assert links_found(op.link_counts(docs, op.Rule())) == brute_links([(i, t) for i, t, _ in doc_rows], op.Rule())
    assert op.link_counts(empty, op.Rule()).count() == 0
