"""Periodic run detection by Lempel-Ziv blocks, from a longest-previous-factor array.

Texts are sequences of words. A task takes many of them as one array of word numbers, different in each text, so that
nothing is ever equal across texts:

1. Prefix doubling sorts the suffixes; the ranks of each doubling stay. Two positions have 2^l words in common if their ranks of
   level l are equal, which gives the longest common extension of two positions, to the right or left, in as many steps as levels.
2. The longest previous factor of a position is its longest extension with one of the nearest smaller positions before
   and after it in the suffix array. Blocks begin at 0; each is the longest previous factor of its start, or one word.
3. Main's boundary extensions: a run of three periods or more that touches a block's edge has a period no longer than the longer one
   of both blocks, and two positions a period apart, one of which is the edge, whose extensions make it up. All these pairs are looked at.
4. Every other run lies strictly inside a block, which is a copy of earlier words: runs are kept in buckets by their start, and
   those of the block's source are copied, in ascending order, so that copies inside a block that overlaps its source are copied on.

Step 3 is for blocks of EDGE words or more on either side and for texts with a previous factor of LEAST - LEAST // 3 words or
more, as every run of LEAST words and three periods has such ones.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

#: A run's words and periods at least.
LEAST = 24
PERIODS = 3
#: A power of two, at most half of what two shifted copies of a shortest run have in common (16 words).
EDGE_LEVEL = 3
EDGE = 1 << EDGE_LEVEL
GROUP_CHARS = 2 << 20

Run = tuple[int, int, int]


class Suffixes:
    """The suffix array of an array of numbers and the ranks of each doubling; ranks have one more place, -1, after the last position."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.order = np.argsort(codes, kind="stable")
        key = codes[self.order]
        slots, rank = np.arange(n), np.full(n + 1, -1, np.int32)
        self.levels: list[np.ndarray] = []
        while len(slots) or not self.levels:
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[self.order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] if len(slots) else slots
            self.levels.append(rank)
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]
            at = self.order[slots]
            key = (rank[at].astype(np.int64) << 32) | (rank[np.minimum(at + (1 << (len(self.levels) - 1)), n)] + 1)
            by = np.argsort(key, kind="stable")
            self.order[slots], key = at[by], key[by]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i and j differ."""
        out = np.zeros(len(i), np.int64)
        left = np.flatnonzero(self.levels[0][i] == self.levels[0][j])
        for level in range(len(self.levels)):
            more = self.levels[level + 1] if level + 1 < len(self.levels) else None
            same = more[i[left]] == more[j[left]] if more is not None else np.zeros(len(left), bool)
            ends = left[~same]
            out[ends] = self._down(i[ends], j[ends], level)
            left = left[same]
        return out

    def _down(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """forward() of positions with 2^level words in common, but not twice as many."""
        n = np.full(len(i), 1 << level, np.int64)
        for low in range(level - 1, -1, -1):
            rank = self.levels[low]
            n += (rank[i + n] == rank[j + n]).astype(np.int64) << low
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words just before i and just before j are equal; i < j."""
        n = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], 1 << level
            a, b = i - n - size, j - n - size
            n += ((a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << level
        return n

    def nearest_smaller(self, step: int) -> np.ndarray:
        """For each slot of the suffix array the next one in direction `step` with a smaller position, within suffixes of
        one first word; other values where there is none."""
        n, s = len(self.order), np.append(self.order, -1)
        first = np.append(self.levels[0][self.order], -1)
        p = np.arange(n) + step
        left = np.flatnonzero((first[p] == first[:-1]) & (s[p] > s[:-1]))
        while len(left):
            p[left] = p[p[left]]
            q = p[left]
            left = left[(first[q] == first[left]) & (s[q] > s[left])]
        return np.where(first[p] == first[:-1], s[p], -1)

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each position the length of the longest factor that also begins before it, and where; 0 and -1 for none."""
        n = len(self.order)
        length, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for step in (-1, 1):
            q = self.nearest_smaller(step)
            have = np.flatnonzero(q >= 0)
            at, q = self.order[have], q[have]
            found = self.forward(at, q)
            better = found > length[at]
            length[at[better]], where[at[better]] = found[better], q[better]
        return length, where


def blocks(length: np.ndarray, start: int, end: int) -> list[int]:
    """Where the Lempel-Ziv blocks of a text begin, and its end."""
    jump, out, i = np.maximum(length[start:end], 1).tolist(), [], 0
    while i < end - start:
        out.append(start + i)
        i += jump[i]
    return [*out, end]


def edge_runs(suffixes: Suffixes, edges: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, periods: int) -> list[Run]:
    """Runs (start, end, period) that touch the edges between blocks of `before` and `after` words in texts from starts to ends;
    some are found several times, or with multiples of their period too."""
    if len(suffixes.levels) <= EDGE_LEVEL:
        return []
    most = np.minimum(np.maximum(before, after), (ends - starts) // periods)
    use = np.flatnonzero((np.maximum(before, after) >= EDGE) & (most > 0))
    if not len(use):
        return []
    rank, out = suffixes.levels[EDGE_LEVEL], []
    for part in common.chunks(use.tolist(), most[use].tolist(), 1 << 20):
        part = np.array(part)
        of = np.repeat(part, most[part])
        p = np.arange(len(of)) - np.repeat(np.cumsum(most[part]) - most[part], most[part]) + 1
        for shift in (0, 1):
            x = edges[of] - p * (1 - shift)
            y = x + p
            ok = (x >= starts[of]) & (y <= ends[of])
            x, y, q = x[ok], y[ok], p[ok]
            ok = (rank[x] == rank[y]) | ((x >= EDGE) & (rank[np.maximum(x - EDGE, 0)] == rank[np.maximum(y - EDGE, 0)]))
            x, y, q = x[ok], y[ok], q[ok]
            a, b = x - suffixes.backward(x, y), y + suffixes.forward(x, y)
            ok = b - a >= np.maximum(least, periods * q)
            out += zip(a[ok].tolist(), b[ok].tolist(), q[ok].tolist(), strict=True)
    return out


def copied(runs: dict[int, dict[int, int]], cut: list[int], where: np.ndarray, least: int) -> None:
    """Adds to the buckets `runs`, start to end to period, of one text those that lie strictly inside its blocks."""
    starts = sorted(runs)
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a < least + 2:
            continue
        shift = a - int(where[a])
        todo = starts[bisect.bisect_right(starts, a - shift) : bisect.bisect_left(starts, b - shift)]
        while todo:
            s = heapq.heappop(todo)
            for e, p in list(runs[s].items()):
                if e < b - shift and s + shift < b:
                    if s + shift not in runs:
                        runs[s + shift] = {}
                        bisect.insort(starts, s + shift)
                        if s + shift < b - shift:
                            heapq.heappush(todo, s + shift)
                    bucket = runs[s + shift]
                    bucket[e + shift] = min(p, bucket.get(e + shift, p))


def find_runs(texts: list[list[bytes]], least: int = LEAST, periods: int = PERIODS) -> list[list[Run]]:
    """Of each text, a list of words, all (start, length, period) of at least `least` words and `periods` times their
    smallest period, by start and period. `least` is 24 or more and `periods` 3 or more, which the search builds on."""
    if least < LEAST or periods < PERIODS:
        raise ValueError(f"runs have {LEAST} words and {PERIODS} periods or more")
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = sizes.cumsum()
    starts = ends - sizes
    found: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(texts)), sizes) * len(words.dictionary)
    suffixes = Suffixes(codes)
    length, where = suffixes.previous_factors()
    top = np.zeros(len(texts), np.int64)
    have = np.flatnonzero(sizes)
    top[have] = np.maximum.reduceat(length, starts[have])
    cuts = {k: blocks(length, int(starts[k]), int(ends[k])) for k in np.flatnonzero(top >= least - least // periods).tolist()}
    if not cuts:
        return found
    edges = np.concatenate([np.array(c) for c in cuts.values()])
    of = np.repeat(np.array(list(cuts)), [len(c) for c in cuts.values()])
    size = np.diff(edges)
    before, after = np.append(0, size), np.append(size, 0)
    before[edges == starts[of]], after[edges == ends[of]] = 0, 0
    runs: dict[int, dict[int, dict[int, int]]] = {}
    for a, b, p in edge_runs(suffixes, edges, before, after, starts[of], ends[of], least, periods):
        bucket = runs.setdefault(int(np.searchsorted(ends, a, "right")), {}).setdefault(a, {})
        bucket[b] = min(p, bucket.get(b, p))
    for k, buckets in runs.items():
        copied(buckets, cuts[k], where, least)
        base = int(starts[k])
        found[k] = sorted((a - base, b - a, p) for a, of_start in buckets.items() for b, p in of_start.items())
    return found


def words_of(doc_id: int | None, text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def planted_words(doc_id: int | None, text: str) -> list[bytes]:
    """The words of the query: of some texts, by doc_id, the end is made periodic."""
    words = words_of(doc_id, text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0).tolist()]
    return b" ".join(words)


def detect(docs: DataFrame, words: Callable[[int | None, str], list[bytes]] = words_of, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, runs (array of start, length, period, in words) and
    collapsed, its words without the repetitions.

    `words` gives the words of a text. A null text counts as empty, which has no runs; repeated rows and null doc_ids give rows of their
    own; an empty table gives none. A text is one task's work, however long: about 100 bytes a word.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            listed = [words(i, t) for i, t in zip(ids, texts, strict=True)]
            found = find_runs(listed, least, periods)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            left = pa.array(map(collapsed, listed, found), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(item)), left.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents, some of them made periodic."""
    got = detect(common.load(spark, sf_dir, "documents"), planted_words)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    # A run is before another one if its exponent is greater; exponents are compared as products.
    ahead = lambda a, b: (a["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)")) > (b["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)"))
    top = F.aggregate("runs", F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)"), lambda best, r: F.when(best.isNull() | ahead(r, best), r).otherwise(best))
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * cast(top.length as decimal(19, 0))) div cast(top.period as decimal(19, 0))").cast("long")
    return got.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
