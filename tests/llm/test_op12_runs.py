import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlane.llm import common
from barlane.llm import op12_runs as op


def brute(words, least=24, periods=3):
    """Every stretch of equal words one period apart, of every period."""
    out = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_query(doc_id, text):
    words = [w.encode() for w in common.WORD.findall(text or "")]
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rng):
    """Words of a small vocabulary with periodic stretches and copies of earlier stretches."""
    out = []
    while len(out) < rng.randrange(30, 500):
        kind = rng.randrange(4)
        if kind == 0:
            out += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))]
        elif kind == 1:
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 15))]
            n = rng.randrange(1, 8 * len(unit))
            out += (unit * 9)[:n]
        elif out:
            i = rng.randrange(len(out))
            out += out[i : i + rng.randrange(1, 200)]
    return [w.encode() for w in out]


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    texts = [made(rng) for _ in range(400)] + [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 700, [b"a", b"b"] * 300]
    # Fibonacci words have runs inside of runs, square-rich words many short periods.
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 700:
        a, b = b, b + a
    texts += [b * 4, [bytes([97 + bin(i).count("1") % 2]) for i in range(512)] * 3]
    got = op.find_runs(texts)
    for text, runs in zip(texts, got, strict=True):
        assert runs == brute(text)
    assert sum(map(len, got)) > 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"x", b"y", b"z"]), min_size=1, max_size=9), st.integers(1, 40)), min_size=1, max_size=6))
def test_runs_of_powers(parts):
    words = [w for unit, n in parts for w in unit * n][:400]
    assert op.find_runs([words, words[::-1]]) == [brute(words), brute(words[::-1])]


def test_suffix_array_and_previous_factors():
    rng = random.Random(2)
    for size, letters in ((1, 1), (60, 2), (200, 3), (90, 50), (120, 1)):
        x = np.array([rng.randrange(letters) for _ in range(size)], np.int64)
        s = op.Suffixes(x)
        t = x.tolist()
        assert s.order.tolist() == sorted(range(size), key=lambda i: t[i:])
        length, where = s.previous_factors()
        common_words = lambda i, j: next((k for k in range(size - i) if t[i + k] != t[j + k]), size - i)
        for i in range(size):
            assert length[i] == max((common_words(i, j) for j in range(i)), default=0)
            assert length[i] == 0 or common_words(i, where[i]) == length[i] and where[i] < i


def test_lower_limits_are_refused():
    with pytest.raises(ValueError):
        op.find_runs([[b"a"] * 30], least=10)
    with pytest.raises(ValueError):
        op.find_runs([[b"a"] * 30], periods=2)


def test_longer_runs_and_more_periods():
    rng = random.Random(3)
    texts = [made(rng) for _ in range(60)]
    assert op.find_runs(texts, 40, 5) == [brute(t, 40, 5) for t in texts]


def test_rows(spark, docs, doc_rows):
    rows = op.detect(docs).collect()
    words = lambda t: (t or "").encode().split()
    want = sorted(repr((i, brute(words(t)))) for i, t, _ in doc_rows if len(words(t)) < 15_000)
    assert len(rows) == len(doc_rows)
    found = [repr((r["doc_id"], [tuple(x) for x in r["runs"]])) for r in rows]
    assert [x for x in want if x not in found] == []
    ab = next(r for r in rows if r["doc_id"] == 22)
    assert [tuple(x) for x in ab["runs"]] == [(0, 10_000, 2)] and ab["collapsed"] == "a b"


def test_empty(empty):
    assert op.detect(empty).collect() == []


def test_query_is_brute_force(spark, sf_dir):
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text").collect()
    small = [r for r in docs if len(r["text"] or "") < 20_000]
    assert len(small) > len(docs) * 0.8
    got = {r["doc_id"]: tuple(r) for r in op.op12_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in small:
        assert got[r["doc_id"]] == brute_query(r["doc_id"], r["text"])
    assert sum(x[1] > 0 for x in got.values()) > 5
