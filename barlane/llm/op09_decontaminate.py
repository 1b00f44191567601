"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are parted by the size of their shingle sets, [2^j, 2^(j+1)), and each part is searched by itself, in a table of
its own with its own numbers of hits. All items of a part have MinHash sketches of the
same length: the 2^j smallest hashes of their shingles, SKETCH at most. These are a random sample of an item's shingles, so
the share of them that a document holds estimates how much of the item it holds. The search looks up the shingles of a
document among a part's sketch values and takes items with enough hits: as many as an item at the threshold must have, or,
where a sketch is shorter than what may be missing can rule out, as many as one at the threshold has but for a chance of
`miss`. So recall is 1 for items whose sketch is longer than what may be missing (up to 320 shingles at 0.8), and 1 - miss for each longer
one; a miss of 0 makes sketches as long as that takes, and recall 1 for all. Each candidate is verified on the shingles themselves,
not on their hashes.

Items go to the tasks in blocks of about BLOCK_CHARS characters, one after another: a block's sketches are broadcast, its
pass over the documents is written, and its broadcast is dropped before the next. So what the driver and the workers hold
has a fixed bound, and a larger benchmark takes more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common, shingles

SIZE = 5
THRESHOLD = 0.8
#: Longest sketch, and the chance by which one may miss an item at the threshold.
SKETCH = 64
MISS = 1e-9
BLOCK_CHARS = 16 << 20
GROUP_CHARS = 2 << 20
LEAKS = "did long, th long, item_id long, n_shingles long, n_found long, containment double"


def most_missing(n: int, threshold: float) -> int:
    """How many of n shingles may be missing at the threshold."""
    return n - math.ceil(threshold * n - 1e-9)


def sketch_length(n: int, missing: int, miss: float) -> int:
    """Values in the sketch of an item of n shingles: by its size class, or with no `miss` one more than may be missing if that is more."""
    length = min(SKETCH, 1 << (n.bit_length() - 1))
    return length if miss else max(length, missing + 1)


def least_hits(n: int, length: int, missing: int, miss: float = MISS) -> int:
    """How many of the `length` sketch values of an item of n shingles a document holds at least if `missing` of them are
    not in it: for certain if that is more than none, else but for a chance of `miss` (hypergeometric)."""
    sure = length - missing
    if sure > 0:
        return sure
    log_comb = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    chance, hits = 0.0, 0
    while hits < length:
        chance += math.exp(log_comb(n - missing, hits) + log_comb(missing, length - hits) - log_comb(n, length)) if hits <= n - missing else 0.0
        if chance > miss:
            break
        hits += 1
    return max(1, hits)


class Sketches:
    """The sketches of a block of items. Items themselves are kept as texts only."""

    def __init__(self, items: list[tuple[int | None, str]], size: int, threshold: float, miss: float = MISS) -> None:
        hasher = shingles.Hasher()
        self.size, self.threshold = size, threshold
        self.ids: list[int | None] = []
        self.texts: list[bytes] = []
        need, entries = [], {}
        for item_id, text in items:
            ws = shingles.words(text)
            if not ws:
                continue
            k = min(size, len(ws))
            s = np.unique(shingles.runs(hasher.words([ws])[0], k))
            missing = most_missing(len(s), threshold)
            length = sketch_length(len(s), missing, miss)
            entries.setdefault((k, len(s).bit_length()), []).append((s[:length], len(self.ids)))
            need.append(least_hits(len(s), length, missing, miss))
            self.ids.append(item_id)
            self.texts.append(b" ".join(ws))
        self.need = np.array(need, np.int64)
        #: By words of a shingle and size class: ascending distinct sketch values, where each one's items begin, all items, and a
        #: table of the values' first bits.
        self.tables = {part: self._table(of) for part, of in sorted(entries.items())}

    @staticmethod
    def _table(of: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        every = np.concatenate([s for s, _ in of])
        items = np.repeat(np.array([i for _, i in of], np.int64), [len(s) for s, _ in of])
        order = np.argsort(every, kind="stable")
        values, begin = np.unique(every[order], return_index=True)
        bits = min(22, max(16, (16 * len(values)).bit_length()))
        shift = np.uint64(64 - bits)
        marks = np.zeros(1 << bits, bool)
        marks[(values >> shift).astype(np.int64)] = True
        return values, np.append(begin, len(every)), items[order], marks, shift

    def candidates(self, h: np.ndarray) -> list[int]:
        """Items with enough sketch values among the shingles of a document, by the hashes of its words."""
        out: list[int] = []
        runs: dict[int, np.ndarray] = {}
        for (k, _), (values, begin, items, marks, shift) in self.tables.items():
            if k not in runs:
                runs[k] = shingles.runs(h, k)
            found = runs[k][marks[(runs[k] >> shift).astype(np.int64)]]
            if len(found):
                place = np.minimum(np.searchsorted(values, found), len(values) - 1)
                place = np.unique(place[values[place] == found])
                if len(place):
                    which, n = np.unique(np.concatenate([items[begin[p] : begin[p + 1]] for p in place.tolist()]), return_counts=True)
                    out += which[n >= self.need[which]].tolist()
        return out

    def verify(self, ws: list[bytes], which: list[int]) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, shingles, shingles found in the document) of the items that reach the threshold."""
        grams = lambda words, k: set(zip(*(words[j : len(words) - k + 1 + j] for j in range(k)), strict=True))
        sets: dict[int, set] = {}
        for i in which:
            words = self.texts[i].split()
            k = min(self.size, len(words))
            if k not in sets:
                sets[k] = grams(ws, k)
            own = grams(words, k)
            n = len(own & sets[k])
            if len(own) - n <= most_missing(len(own), self.threshold):
                yield self.ids[i], len(own), n


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct item texts, each with its smallest item_id, in blocks by the hash of the text."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in block.collect()]


def search(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, every_id: bool = False, miss: float = MISS) -> DataFrame:
    """Leaks of `benchmark` (item_id, text) in `docs` (doc_id, text; other columns of both are left out), as doc_id, item_id, n_shingles, n_found and containment: the share of an
    item's distinct shingles that a document holds is `threshold` or more.

    Shingles are `size` words; an item with fewer words is one shingle of all its words, searched as that run. Items
    with equal texts count once, under the smallest item_id, or with `every_id` under each of their ids, to which the leaks of the first are
    joined back. Null or empty texts hold nothing and are found nowhere.
    A null doc_id is returned as such; repeated rows each give their pairs. Empty tables give no pairs.
    """
    found = leaks(docs, benchmark, size, threshold, block_chars, miss).drop("th")
    if every_id:
        ids = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("th"), "text").distinct()
        first = ids.groupBy("th", "text").agg(F.min("item_id").alias("first"))
        members = ids.join(first, ["th", "text"]).select(F.col("first").alias("of"), F.col("item_id").alias("member"))
        found = found.join(members, F.col("item_id").eqNullSafe(F.col("of"))).withColumn("item_id", F.col("member")).drop("of", "member")
    return found.withColumn("did", common.unfold(F.col("did"))).withColumnRenamed("did", "doc_id")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, miss: float = MISS) -> DataFrame:
    """search() with documents named by did, their folded doc_id, and th, the hash of their text."""
    rows = docs.select(common.fold(F.col("doc_id")).alias("did"), F.xxhash64("text").alias("th"), "text").where(F.col("text").isNotNull())
    found: DataFrame | None = None
    for items in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Sketches(items, size, threshold, miss))
        got = common.written(_search(rows, shared), "leaks")
        shared.destroy()
        found = got if found is None else found.unionAll(got)
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found


def _search(rows: DataFrame, shared: Broadcast) -> DataFrame:
    names = [c.split()[0] for c in LEAKS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, hasher = shared.value, shingles.Hasher()
        for keys, texts in common.grouped(batches, GROUP_CHARS):
            listed = [shingles.words(t) for t in texts]
            out = []
            for key, ws, h in zip(keys, listed, hasher.words(listed), strict=True):
                if which := s.candidates(h):
                    out += [(key["did"], key["th"], i, n, f, f / n) for i, n, f in s.verify(ws, which)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return common.map_arrow(rows.select(F.struct("did", "th").alias("key"), "text"), run, LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose own text leaks no item, whatever other rows share their doc_id."""
    did, th = common.fresh(docs, "did", "th")
    gone = leaks(docs, benchmark).select(F.col("did").alias(did), F.col("th").alias(th)).distinct()
    return docs.join(gone, (common.fold(docs["doc_id"]) == F.col(did)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all benchmark items in all documents."""
    return search(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


def op9_decontaminate_every_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_decontaminate with the pairs of all item_ids, where items share a text."""
    return search(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"), every_id=True)


SQL = r"""
WITH items AS (
    SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM items
), item_shingles AS (
    SELECT DISTINCT item_id, least(5, len(w)) AS k, list_slice(w, i, i + least(5, len(w)) - 1) AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
    SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), doc_shingles AS (
    SELECT DISTINCT doc_id, k, list_slice(w, i, i + k - 1) AS s
    FROM (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM doc_words, (SELECT DISTINCT k FROM item_shingles))
), found AS (
    SELECT doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM found JOIN sizes USING (item_id) WHERE 10 * n_found >= 8 * n_shingles
"""

#: The same with every item_id, where items share a text.
SQL_EVERY_ID = f"""
WITH firsts AS ({SQL}), members AS (
    SELECT item_id AS member, min(item_id) OVER (PARTITION BY text) AS item_id FROM benchmark WHERE text IS NOT NULL
)
SELECT doc_id, member AS item_id, n_shingles, n_found, containment FROM firsts JOIN members USING (item_id)
"""
