"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A vector is permuted by a cyclic shift; an n-gram of three letters is
bound into one vector as shift(shift(v1)) * shift(v2) * v3. A text's vector is the sum (bundle) of the vectors of all
its n-grams, a language's prototype the bundle of all its training texts, each with the same weight. A document gets
the language whose prototype has the largest cosine with its vector.

Letters are taken in lower case; runs of other characters are one boundary letter. Every letter of every script has a
vector of its own, drawn from the place in one stream of random numbers that its code gives. Vectors of n-grams of a-z
are made at the start; those of others are bound when they are met, and the first MOST_OTHER of a worker's are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

DIMENSIONS = 512
SEED = 20260101
#: Codes of the boundary and a-z, and of all letters: others have their code point after these.
LATIN = 1 + 26
LETTERS = LATIN + 0x110000
#: N-grams of LATIN codes only, which come first.
KEPT = LATIN**3
#: Other n-grams whose vectors a worker keeps (16 MB).
MOST_OTHER = 1 << 15
UNKNOWN = "und"
GROUP_CHARS = 1 << 20


class Space:
    """The letter vectors, made when they are met, and the vectors of all three-letter n-grams of a-z and the boundary."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        if dimensions % 2:
            raise ValueError("the number of dimensions must be even")
        self.dimensions, self.seed = dimensions, seed
        self.place = np.full(LETTERS, -1, np.int32)
        self.known, self.n_known = np.empty((64, dimensions), np.int8), 0
        codes = np.arange(LATIN)
        self.grams = self.bound(*(x.ravel() for x in np.meshgrid(codes, codes, codes, indexing="ij")))
        self.codes = np.array([self.code(c) for c in range(0x10000)], np.int64)
        #: Other n-grams that are kept, ascending, and the rows of their vectors.
        self.other, self.rows = np.empty(0, np.int64), np.empty(0, np.int64)
        self.table = np.empty((0, dimensions), np.int8)

    @staticmethod
    def code(point: int) -> int:
        """A code point's code: 0 if it is no letter."""
        return 0 if not chr(point).isalpha() else point - 96 if 97 <= point <= 122 else LATIN + point

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The letters' vectors. That of code c is row c of all rows drawn one after another: two numbers come from each
        64-bit step of the generator, which can go to any step at once."""
        for c in np.unique(codes[self.place[codes] < 0]).tolist():
            if self.n_known == len(self.known):
                self.known = np.concatenate([self.known, np.empty_like(self.known)])
            stream = np.random.PCG64(self.seed).advance(c * self.dimensions // 2)
            self.known[self.n_known] = np.random.Generator(stream).choice(np.array([-1, 1], np.int8), self.dimensions)
            self.place[c], self.n_known = self.n_known, self.n_known + 1
        return self.known[self.place[codes]]

    def bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The vectors of n-grams by their letters' codes."""
        return np.roll(self.vectors(a), 2, 1) * np.roll(self.vectors(b), 1, 1) * self.vectors(c)

    def others(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams with letters beyond a-z, by their numbers, which are distinct."""
        place = np.minimum(np.searchsorted(self.other, grams), max(len(self.other) - 1, 0))
        known = self.other[place] == grams if len(self.other) else np.zeros(len(grams), bool)
        out = np.empty((len(grams), self.dimensions), np.int8)
        out[known] = self.table[self.rows[place[known]]]
        if not known.all():
            new = grams[~known]
            out[~known] = vectors = self.bound(new // LETTERS**2, new // LETTERS % LETTERS, new % LETTERS)
            new, vectors = new[: MOST_OTHER - len(self.other)], vectors[: MOST_OTHER - len(self.other)]
            if len(new):
                have = len(self.other)
                if have + len(new) > len(self.table):
                    self.table = np.concatenate([self.table, np.empty((max(1024, len(self.table), len(new)), self.dimensions), np.int8)])
                self.table[have : have + len(new)] = vectors
                both, rows = np.append(self.other, new), np.append(self.rows, np.arange(have, have + len(new)))
                order = np.argsort(both)
                self.other, self.rows = both[order], rows[order]
        return out

    def letters(self, text: str) -> np.ndarray:
        """Codes of a text: 0 for a boundary, runs of which are one; a boundary stands at both ends."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() >= 0x10000:
            high = np.array([self.code(p) if p >= 0x10000 else 0 for p in points.tolist()], np.int64)
            codes = np.where(points < 0x10000, self.codes[np.minimum(points, 0xFFFF)], high)
        else:
            codes = self.codes[points]
        codes = np.concatenate([[0], codes, [0]]).astype(np.int64)
        return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram numbers, their counts), ascending; empty if the text has no letter. Numbers below KEPT are rows of grams."""
        codes = self.letters(text)
        if len(codes) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        kept = (a < LATIN) & (b < LATIN) & (c < LATIN)
        counts = np.bincount((a[kept] * LATIN + b[kept]) * LATIN + c[kept], minlength=KEPT)
        which = np.flatnonzero(counts)
        if kept.all():
            return which, counts[which]
        other, n = np.unique((a[~kept] * LETTERS + b[~kept]) * LETTERS + c[~kept], return_counts=True)
        return np.concatenate([which, KEPT + other]), np.concatenate([counts[which], n])

    def weighted(self, which: np.ndarray, weights: np.ndarray, kind: type = np.float32) -> np.ndarray:
        """The sum of the vectors of n-grams by number, each times its weight."""
        first = int(np.searchsorted(which, KEPT))
        out = np.zeros(self.dimensions, kind)
        for at in range(0, len(which), 4096):
            for low, high in ((at, min(at + 4096, first)), (max(at, first), min(at + 4096, len(which)))):
                if low < high:
                    some = which[low:high]
                    vectors = self.grams[some] if high <= first else self.others(some - KEPT)
                    out += weights[low:high].astype(kind) @ vectors.astype(kind)
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """A text's vector, or None if it has no letter."""
        which, counts = self.counts(text)
        return self.weighted(which, counts) if len(which) else None


_space: list[Space] = []


def space() -> Space:
    if not _space:
        common.worker_env()
        _space.append(Space())
    return _space[0]


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes, by language, of `docs` (doc_id, text, lang): rows with a lang that are not held out.

    Every task bundles its rows and gives one vector a language; the driver adds up these, whose number is that of
    tasks times languages. Languages without a text that has a letter get no prototype.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out_col(F.col("doc_id"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sums, rest = space(), {}, {}
        for langs, texts in common.grouped(batches, GROUP_CHARS):
            for lang, text in zip(langs, texts, strict=True):
                which, counts = s.counts(text)
                if len(which):
                    first, weights = int(np.searchsorted(which, KEPT)), counts / np.linalg.norm(counts)
                    sums.setdefault(lang, np.zeros(KEPT))[which[:first]] += weights[:first]
                    rest[lang] = rest.get(lang, 0) + s.weighted(which[first:], weights[first:], np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "bundle": [(_bundle(s, x) + rest[lang]).tobytes() for lang, x in sums.items()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(data)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "bundle": [x.tobytes() for x in sums.values()]})

    schema = "lang string, bundle binary"
    partial = common.map_arrow(rows, run, schema)
    total: dict[str, np.ndarray] = {}
    for r in common.map_arrow(partial.repartition(16, F.spark_partition_id()), add, schema).collect():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["bundle"])
    return {lang: total[lang] for lang in sorted(total)}


def _bundle(s: Space, weights: np.ndarray) -> np.ndarray:
    which = np.flatnonzero(weights)
    return s.weighted(which, weights[which], np.float64)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, held_out, lang_pred, score.

    score is the largest cosine, 0 where that is negative; of equal cosines the first language by name wins. A null
    text, one without a letter, and any text when nothing was learned, give `und` and 0. Repeated rows and null doc_ids
    give rows of their own; an empty table gives none.
    """
    langs = list(prototypes)
    unit = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-30) for x in langs], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space()
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            pred, score = [], []
            for text in texts:
                vector = s.bundle(text) if langs else None
                if vector is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cos = unit @ vector / max(float(np.linalg.norm(vector)), 1e-30)
                best = int(cos.argmax())
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": [common.held_out(i) for i in ids], "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: prototypes from all training rows of documents, then all documents."""
    docs = common.load(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
