import random

import pytest

from barlane.llm import common, op09_decontaminate as op, shingles

ITEMS = "item_id long, text string, score string"


def grams(text, k):
    w = shingles.words(text or "")
    return set(zip(*(w[i : len(w) - k + 1 + i] for i in range(k)), strict=True))


def brute(docs, items, size=5, num=8, den=10):
    least = {}
    for i, t in items:
        if t is not None:
            least[t] = min(least.get(t, i), i)
    out = []
    for t, i in least.items():
        k = min(size, len(shingles.words(t)))
        if k:
            own = grams(t, k)
            for d, x in docs:
                n = len(own & grams(x, k))
                if den * n >= num * len(own):
                    out.append((str(d), i, len(own), n))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["item_id"], r["n_shingles"], r["n_found"]) for r in df.collect())


def cases():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(60)]
    items += [(70, items[5][1]), (71, None), (72, ""), (73, "A0 b1"), (74, items[9][1].upper())]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1] or ""
            p = part.split()
            if p and rng.random() < 0.5:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_search_matches_brute_force(spark, make_docs, block):
    docs, items = cases()
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    want = brute(docs, items)
    assert len(want) > 50 and any(n < m for _, _, m, n in want)
    assert found(op.search(make_docs(docs).repartition(3), bench, block_chars=block)) == want


def test_edge_documents(spark, docs, doc_rows, empty):
    bench = spark.createDataFrame([(1, " ".join((doc_rows[0][1]).split()[5:30]), "c"), (2, "word", "c"), (3, None, "c"), (4, " \n", "c")], ITEMS)
    got = op.search(docs, bench)
    assert found(got) == brute([(i, t) for i, t, _ in doc_rows], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert op.search(empty, bench).count() == 0
    assert op.search(docs, bench.limit(0)).count() == 0
    clean = op.clean(docs, bench)
    assert clean.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t, _ in doc_rows if not brute([(i, t)], items))


def test_clean_rows_stay_beside_leaking_ones_of_the_same_id(spark, make_docs):
    item, other = "one two three four five six seven eight", "these are quite different words of a clean document"
    rows = [(None, item), (None, other), (5, item), (5, other), (5, None), (6, f"{other} {item}")]
    got = op.clean(make_docs(rows), spark.createDataFrame([(1, item, "c")], ITEMS))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == [("5", ""), ("5", other), ("None", other)]


def test_recall_of_items_longer_than_their_sketches():
    rng = random.Random(6)
    items = [((i,), " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate([150, 200, 400, 900] * 12)]
    s = op.Sketches(items, 5, 0.8)
    hasher, caught, true = shingles.Hasher(), 0, 0
    for i, ((_,), text) in enumerate(items):
        ws = shingles.words(text)
        for _ in range(3):
            v = list(ws)
            for at in rng.sample(range(len(v)), int(0.04 * len(v))):
                v[at] = b"x%d" % rng.randrange(10**6)
            if i in [ids[0] for ids, _, _ in s.verify(v, [i])]:
                true += 1
                caught += i in s.candidates(hasher.words([v])[0])
    assert true > 50 and caught == true


@pytest.mark.parametrize(("n", "length", "missing"), [(3, 2, 0), (63, 32, 12), (127, 64, 25), (400, 64, 80), (5000, 64, 1000)])
def test_least_hits(n, length, missing):
    rng = random.Random(n)
    need = op.least_hits(n, length, missing)
    assert 0 < need <= length
    assert min(sum(x >= missing for x in rng.sample(range(n), length)) for _ in range(300)) >= need


def test_sketches_miss_nothing():
    rng = random.Random(1)
    for n in (1, 3, 5, 6, 9, 17, 40, 90):
        text = " ".join(f"w{i}" for i in range(n + 4))
        s = op.Sketches([((1,), text)], 5, 0.8)
        w = text.split()
        for _ in range(60):
            v = list(w)
            v[rng.randrange(len(v))] = "x"
            words = [x.encode() for x in ["p"] * 7 + v + ["q"] * 9]
            own = grams(text, 5)
            inside = 10 * len(own & set(zip(*(words[i:] for i in range(5))))) >= 8 * len(own)  # noqa: B905
            which = s.candidates(shingles.Hasher().words([words])[0])
            assert bool(list(s.verify(words, which))) == inside


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in common.load(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in common.load(spark, sf_dir, "benchmark").collect()]
    assert found(op.op9_decontaminate(spark, sf_dir)) == brute(docs, items)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_every_id_of_a_repeated_text(spark, make_docs, block):
    docs, items = cases()
    items += [(80, items[5][1]), (81, items[7][1]), (81, items[7][1]), (82, items[11][1]), (82, items[12][1])]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    of = {t: {i for i, x in items if x == t} for _, t in items if t is not None}
    want = sorted((d, i, n, f) for t, ids in of.items() for d, _, n, f in brute(docs, [(0, t)]) for i in ids)
    assert {70, 80} <= {i for _, i, *_ in want}
    assert found(op.search(make_docs(docs).repartition(3), bench, block_chars=block, every_id=True)) == want


def test_long_items_without_a_chance_to_miss(spark, make_docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((50, 330, 700, 1500, 4000))]
    docs = []
    for d, (_, t) in enumerate(items):
        w = t.split()
        docs += [(d, " ".join(w[: len(w) * 85 // 100])), (d + 10, " ".join(w[: len(w) * 75 // 100]))]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    assert found(op.search(make_docs(docs), bench, miss=0.0)) == brute(docs, items)
    for n in (1, 2, 64, 319, 330, 5000):
        missing = op.most_missing(n, 0.8)
        length = op.sketch_length(n, missing, 0.0)
        assert length <= n and op.least_hits(n, length, missing, 0.0) == length - missing >= 1


@pytest.mark.parametrize("every", [False, True])
def test_queries_are_their_sql(spark, sf_dir, every):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    query, sql = (op.op9_decontaminate_every_id, op.SQL_EVERY_ID) if every else (op.op9_decontaminate, op.SQL)
    want = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, query(spark, sf_dir).select(*names).collect())) == sorted(want)
