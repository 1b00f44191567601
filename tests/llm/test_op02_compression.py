import re
from collections import Counter

import zstandard

from barlane.llm import common, op02_compression as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def kept(text):
    data = (text or "").encode()
    if brute(text)[5]:
        return False
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) / len(b)
    low, high = next((lo, hi) for most, lo, hi in op.BANDS if len(data) < most)
    if not low <= ratio(data) <= high:
        return False
    parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    if len(parts) > 1 and len(parts[-1]) < 1024:
        parts[-2:] = [parts[-2] + parts[-1]]
    return len(data) <= 4096 or sum(not 0.2 <= ratio(p) <= 0.85 for p in parts) <= 0.25 * len(parts)


def check(rows, want):
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows), key=key)
    assert got == sorted(((i, *brute(t), kept(t)) for i, t in want), key=key)


def test_edge_documents(docs, doc_rows):
    check(op.judge(docs).collect(), [(i, t) for i, t, _ in doc_rows])


def test_empty(empty):
    assert op.judge(empty).count() == 0


def test_repeats():
    words = [b"%d" % (i % 11) for i in range(40)]
    assert op.repeat_words(words) == 40
    assert op.repeat_words(words[:10]) == 0
    assert op.repeat_words([b"a"] * 9) == 9
    assert op.repeat_words([b"a"] * 8) == 0
    assert op.repeat_words([]) == 0


def test_bands():
    import random

    rng = random.Random(1)
    bands = op.Bands()
    assert not bands("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(9000)))[2]
    assert not bands("again and " * 900)[2]
    assert bands("") == (None, None, False)
    prose = " ".join("".join(rng.choice(["ta", "ri", "no", "el", "us", "men"]) for _ in range(rng.randint(1, 4))) for _ in range(3000))
    assert bands(prose)[2]
    assert not bands(prose[:6000] + "x " * 30_000)[2]


def test_chunks_leave_no_byte_out():
    data = bytes(i % 251 for i in range(3 * 4096))
    for n in (0, 1, 1023, 1024, 4095, 4096, 4097, 5119, 5120, 8192, 9000, 9216, 12288):
        parts = op.chunks(data[:n])
        assert b"".join(parts) == data[:n] and all(len(p) == 4096 for p in parts[:-1])
        assert len(parts) == 1 or 1024 <= len(parts[-1]) < 4096 + 1024


def test_query(spark, sf_dir):
    rows = common.load(spark, sf_dir, "documents").collect()
    check(op.op2_compression(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in rows])
