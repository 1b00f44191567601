import hashlib
from collections import defaultdict

import numpy as np
import pytest

from barlane.llm import common, op04_line_dedup as op

SPACE = common.SPACE
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    did = lambda i: common.NO_ID if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(did(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 3 and did(i) != max(h))]
        out.append((str(i), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def found(df):
    rows = df.select("doc_id", "line_dedup.*").collect()
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows)


def test_edge_documents(docs, doc_rows):
    got = op.dedup(docs)
    assert got.columns == [*(c for c in docs.columns if c != "line_dedup"), "line_dedup"]
    assert found(got) == brute([(i, t) for i, t, _ in doc_rows])


@pytest.mark.parametrize("probes", [1 << 16, 8])
def test_hot_line_is_split(make_docs, monkeypatch, probes):
    monkeypatch.setattr(op, "PROBE_ROWS", probes)
    monkeypatch.setattr(op, "SHARD_KEYS", 10)
    rows = [(i, f"the line that all of them share\nown line number {i:05d} of this one\nshort\nthe line that all of them share") for i in range(60)]
    rows += [(i, "two documents hold this line") for i in (3, 4)] + [(4, "two documents hold this line")]
    assert found(op.dedup(make_docs(rows).repartition(4))) == brute(rows)


def test_empty(empty):
    assert op.dedup(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 40_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    h = op.PerfectHash.build(keys)
    assert sorted(h(keys).tolist()) == list(range(n))


def test_keys_that_always_meet():
    # equal keys can't be told apart by any level; they end in the ordered rest
    h = op.PerfectHash.build(np.array([5, 5, 9], np.uint64))
    assert h.n == 3 and h(np.array([9], np.uint64))[0] >= 0


def test_shard_bytes_and_fingerprints():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 3000))
    counts, last = rng.integers(1, 400, 3000), rng.integers(-9, 10**9, 3000)
    shard = op.Shard.from_bytes(op.Shard.build(h1, h2, counts, last).to_bytes())
    n, ids = shard.probe(h1, h2)
    assert (n == np.minimum(counts, 255)).all() and (ids == last).all()
    other = rng.integers(-(2**62), 2**62, (2, 3000))
    assert (shard.probe(*other)[0] != 0).sum() <= 1


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in common.load(spark, sf_dir, "documents").collect()]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op.op4_line_dedup(spark, sf_dir).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("least", [255, 256, 300, 301])
def test_least_docs_above_a_byte(make_docs, least):
    rows = [(i, f"the line that all of them share\nown line number {i:05d} of this one") for i in range(300)]
    got = op.dedup(make_docs(rows).repartition(4), least_docs=least).select("line_dedup.n_dropped").collect()
    assert sum(r["n_dropped"] for r in got) == (299 if least <= 300 else 0)


@pytest.mark.parametrize("most", [255, 256, 70_000, 2**33])
def test_counts_up_to_most_are_exact(most):
    h1, h2 = np.random.default_rng(8).integers(-(2**62), 2**62, (2, 500))
    counts = np.random.default_rng(9).integers(1, 2 * most, 500)
    shard = op.Shard.from_bytes(op.Shard.build(h1, h2, counts, h1, most).to_bytes())
    n, last = shard.probe(h1, h2)
    assert (n == np.minimum(counts, most)).all() and (last == h1).all()


def test_many_lines_of_long_texts_go(spark, make_docs):
    lines = [f"This is line number {i} of a long text." for i in range(20_000)]
    own = "A line that stands in this document alone."
    docs = make_docs([(d, "\n".join([own + str(d), *lines])) for d in range(3)])
    got = {r["doc_id"]: r["line_dedup"] for r in op.dedup(docs).collect()}
    assert [got[d]["n_dropped"] for d in range(3)] == [20_000, 20_000, 0]
    assert [got[d]["n_lines"] for d in range(3)] == [20_001] * 3
    assert got[0]["kept_text"] == own + "0" and got[2]["kept_text"].endswith(lines[-1])
