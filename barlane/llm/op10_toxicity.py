"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words in lower case and their first letters (PREFIXES), since insults are inflected; of these the FEATURES
that tell toxic from other training documents best are kept. A document's value of a feature is log(1 + count).
Grades: 0 for documents marked not toxic. Labels do not say how grave a toxic document is; those marked toxic get 1, 2 or 3 by
the tercile of how many features that tell toxic text occur in them, where a document of one half of the sample is judged by
the features of the other half, not by the model's. P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector for all ordered thresholds, fitted by gradient
descent on the likelihood. The expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common, labelled

#: Labelled documents of each class that are learned from, at most.
TRAIN_PER_CLASS = 5000
FEATURES = 512
PREFIXES = (4, 5, 6)
#: Toxic training documents that a feature must be in, and how many times as often it must be in them as in others.
LEAST_DOCS = 5
LEAST_RATIO = 30
GRADES = 4
STEPS = 500
L2 = 1e-4
CACHE_WORDS = 400_000
GROUP_CHARS = 2 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """Features of one run of letters in lower case: itself, and its beginnings marked by an asterisk."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def document_features(text: str) -> set[str]:
    return {f for w in set(_LETTERS.findall(text.lower())) for f in word_features(w)}


@dataclass(frozen=True)
class Ordinal:
    """A learned model."""

    features: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, from w.x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


class Scorer:
    """w.x of texts. Words that a worker has met keep their features' numbers."""

    def __init__(self, model: Ordinal) -> None:
        self.number = {f: i for i, f in enumerate(model.features)}
        self.model, self.cache = model, {}

    def _of(self, token: str) -> tuple[int, ...]:
        return tuple(self.number[f] for w in _LETTERS.findall(token) for f in word_features(w) if f in self.number)

    def counts(self, text: str) -> Counter:
        """Count of each feature, by its number."""
        tokens = text.lower().split()
        cache = self.cache
        found: Counter = Counter()
        for t in set(tokens).difference(cache) if len(cache) < CACHE_WORDS else ():
            cache[t] = self._of(t)
        for t, n in Counter(tokens).items():
            for i in cache[t] if t in cache else self._of(t):
                found[i] += n
        return found

    def z(self, text: str) -> float:
        return float(sum(self.model.weights[i] * np.log1p(n) for i, n in self.counts(text).items()))


def choose(rows: DataFrame, most: int, least_docs: int, least_ratio: float) -> list[tuple[str, ...]]:
    """The `most` features of (text, y, half) that stand out most in toxic rows, by the excess over what other rows let
    expect in units of its deviation: of all rows, and of those of half 0 and of half 1 alone. The rows are read once;
    tasks count theirs before the counts are shuffled."""
    n = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    sums = ("o0", "t0", "o1", "t1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in sums]
        for keys, texts in common.grouped(batches, GROUP_CHARS):
            for k, text in zip(keys, texts, strict=True):
                found[2 * k["half"] + k["y"]].update(document_features(text))
        names = list(set().union(*found))
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string())} | {c: pa.array([of[f] for f in part], pa.int64()) for c, of in zip(sums, found, strict=True)})

    counted = common.map_arrow(rows.select(F.struct("y", "half").alias("key"), "text"), run, "feature string, o0 long, t0 long, o1 long, t1 long")
    counted = common.written(counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in sums)), "toxicity-counts")
    out = []
    for halves in ((0, 1), (0,), (1,)):
        toxic, other = (sum(n.get((y, h), 0) for h in halves) for y in (1, 0))
        t, o = (sum((F.col(f"{c}{h}") for h in halves[1:]), F.col(f"{c}{halves[0]}")) for c in "to")
        if not toxic or not other:
            out.append(())
            continue
        expected = (o + 0.5) * F.lit(toxic / other)
        best = counted.where(t >= least_docs).where(t > least_ratio * expected).orderBy(F.desc((t - expected) / F.sqrt(expected + 1)), "feature").limit(most)
        out.append(tuple(r["feature"] for r in best.collect()))
    return out


def fit(features: tuple[str, ...], x: np.ndarray, grade: np.ndarray) -> Ordinal:
    """Weights and ordered thresholds. With no features or one class only, every document has expected severity near 0."""
    steps = GRADES - 1
    if not len(features) or not len(x) or grade.min() == grade.max():
        return Ordinal(features, np.zeros(len(features)), np.full(steps, 40.0))
    x = x.astype(np.float64)
    balance = np.where(grade == 0, 0.5 / max(1, (grade == 0).sum()), 0.5 / max(1, (grade > 0).sum()))
    # thresholds: a first one, then gaps kept positive by exp
    p = np.concatenate([np.zeros(len(features)), [1.0], np.zeros(steps - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for t in range(1, STEPS + 1):
        w, gaps = p[: len(features)], np.exp(p[len(features) + 1 :])
        cut = p[len(features)] + np.concatenate([[0.0], gaps.cumsum()])
        f = sig(cut[None, :] - (x @ w)[:, None])  # P(grade <= k)
        low = np.concatenate([np.zeros((len(x), 1)), f], 1)
        high = np.concatenate([f, np.ones((len(x), 1))], 1)
        each = np.arange(len(x))
        prob = np.maximum(high[each, grade] - low[each, grade], 1e-9)
        slope = f * (1 - f)
        up = np.where(grade < steps, slope[each, np.minimum(grade, steps - 1)], 0.0) / prob
        down = np.where(grade > 0, slope[each, np.maximum(grade - 1, 0)], 0.0) / prob
        gz = balance * (up - down)  # gradient of the loss by w.x
        gc = np.zeros(steps)
        np.add.at(gc, np.minimum(grade, steps - 1), np.where(grade < steps, -balance * up, 0.0))
        np.add.at(gc, np.maximum(grade - 1, 0), np.where(grade > 0, balance * down, 0.0))
        tail = gc[::-1].cumsum()[::-1]
        g = np.concatenate([x.T @ gz + L2 * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ordinal(features, p[: len(features)], p[len(features)] + np.concatenate([[0.0], np.exp(p[len(features) + 1 :]).cumsum()]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, most: int = FEATURES, least_docs: int = LEAST_DOCS, least_ratio: float = LEAST_RATIO) -> Ordinal:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic) by up to `per_class` documents a class, with up to `most`
    features, each in `least_docs` toxic documents and in `least_ratio` times as many as other documents let expect. It is the
    same however the rows are dealt.

    `labels` has no grades: that of a toxic document is a proxy, how many features it holds that tell toxic documents of the
    other half of the sample.
    """
    rows = labelled.sample(docs, labels, "toxic", per_class, "toxicity-sample")
    rows = rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    features, *halves = choose(rows, most, least_docs, least_ratio)
    judges = halves[::-1]  # each half's judge is learned from the other one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = lambda names: Scorer(Ordinal(names, np.zeros(len(names)), np.zeros(GRADES - 1)))
        scorer, other = blank(features), [blank(j) for j in judges]
        for keys, texts in common.grouped(batches, GROUP_CHARS):
            got = [scorer.counts(t) for t in texts]
            hits = [sum(other[k["half"]].counts(t).values()) for k, t in zip(keys, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k["doc_id"] for k in keys], pa.int64()), "th": pa.array([k["th"] for k in keys], pa.int64()), "y": pa.array([k["y"] for k in keys], pa.int32()), "at": pa.array([list(c) for c in got], pa.list_(pa.int32())), "n": pa.array([list(c.values()) for c in got], pa.list_(pa.int64())), "hits": pa.array(hits, pa.int64())})

    got = common.map_arrow(rows.select(F.struct("y", "half", "doc_id", "th").alias("key"), "text"), run, "doc_id long, th long, y int, at array<int>, n array<long>, hits long").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("th", "ascending")]).to_pylist()
    x = np.zeros((len(got), len(features)), np.float32)
    for k, r in enumerate(got):
        x[k, r["at"]] = np.log1p(r["n"])
    return fit(features, x, grades(np.array([r["y"] for r in got], np.int64), np.array([r["hits"] for r in got])))


def grades(y: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """0 where y is 0, else 1 to 3 by the tercile of the hits among rows where y is 1; if all of these are equal, 2."""
    out = np.zeros(len(y), np.int64)
    if y.any():
        mine = hits[y == 1]
        cuts = np.quantile(mine, [1 / 3, 2 / 3])
        out[y == 1] = 1 + (np.searchsorted(cuts, mine, side="left") + np.searchsorted(cuts, mine, side="right")) // 2
    return out


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, expected_severity (0 to 3), grade (the likeliest),
    p_toxic (probability of a grade above 0), toxic (p_toxic of 0.5 or more).

    A null or empty text has no features. Repeated rows and null doc_ids give rows of their own; an empty table gives
    none. Without labels of both classes no document is toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            above = model.above(np.array([scorer.z(t) for t in texts]))
            each = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], 1)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "expected_severity": above.sum(1), "grade": pa.array(each.argmax(1).astype(np.int32)), "p_toxic": above[:, 0], "toxic": above[:, 0] >= 0.5})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: learn from labels, then grade all documents."""
    docs = common.load(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.load(spark, sf_dir, "labels")))
