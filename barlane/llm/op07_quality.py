"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of its features. Of a preference pair, one document marked good and one marked
bad, the good one is preferred with probability sigmoid(score difference); the weights minimise the logistic loss on
the feature differences of PAIRS pairs. The threshold is the quantile of the training scores that parts good from bad
with the best mean of both classes' accuracy. Scores are mapped to 0..1 so that this threshold lies at CUT.
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
TRAIN_PER_CLASS = 4000
PAIRS = 40_000
CUT = 0.3
L2 = 1e-3
STEPS = 400
SEED = 7
GROUP_CHARS = 2 << 20
_REPEATED_MARK = re.compile(r"[^\w\s]{2,}")


def features(text: str) -> list[float]:
    """Features of a whole text; none depends on anything but the text."""
    import zstandard

    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper = sum(map(str.isupper, words))
    rate = lambda marks: sum(map(text.count, marks)) / n
    digits = sum(map(text.count, "0123456789")) / chars
    ratio = len(zstandard.ZstdCompressor(level=1).compress(data)) / len(data) if data else 1.0
    return [
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        upper / n,
        sum(map(str.istitle, words)) / n,
        rate("!"),
        rate("|"),
        rate("#*$%&"),
        rate("<>{}[]=\\/"),
        rate(".,"),
        rate("?;:"),
        digits,
        len(_REPEATED_MARK.findall(text)) / n,
        len(seen) / n,
        len(seen) / n**0.8,
        seen.most_common(1)[0][1] / n if seen else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        ratio,
        min(1.0, upper / n * 4) + min(1.0, rate("|") * 4) + min(1.0, rate("#*$%&") * 4) + min(1.0, rate("!") * 4),
    ]


@dataclass(frozen=True)
class Ranking:
    """A learned model: knots of each feature, weights of the knots' steps, threshold and scale of scores."""

    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.knots) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1, CUT at the threshold."""
        z = (self.raw(x) - self.threshold) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """How far each feature is from each knot interval's lower to its upper end, 0..1: a piecewise linear basis."""
    low, high = knots[:, :-1], knots[:, 1:]
    return np.clip((x[:, :, None] - low) / np.maximum(high - low, 1e-9), 0, 1).reshape(len(x), -1)


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Learn from features and labels. Without rows of both classes nothing can be ranked: every score is then 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        k = x.shape[1] if x.ndim == 2 and x.shape[1] else len(features(""))
        return Ranking(np.zeros((k, 2)), np.zeros(k), -np.log((1 - CUT) / CUT), 1.0)
    knots = np.quantile(x, [0, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 1], axis=0).T
    e = expand(x, knots)
    rng = np.random.default_rng(SEED)
    i, j = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w, m, v = (np.zeros(e.shape[1]) for _ in range(3))
    for t in range(1, STEPS + 1):
        at = rng.integers(0, PAIRS, 4096)
        d = e[i[at]] - e[j[at]]
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(0) + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = e @ w
    cuts = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, cuts[:1]])
    best = max(cuts.tolist(), key=lambda c: (s[good] >= c).mean() + (s[bad] < c).mean())
    return Ranking(knots, w, best, max(float(s.std()) / 2, 1e-6))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Ranking:
    """A ranking from `docs` (doc_id, text) and `labels` (doc_id, quality) by up to `per_class` documents a class. It is
    the same however the rows are dealt."""
    rows = labelled.sample(docs, labels, "quality", per_class, "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in common.grouped(batches, GROUP_CHARS):
            ids = {c: pa.array([k[c] for k in keys], pa.int64()) for c in ("doc_id", "th", "y")}
            yield pa.RecordBatch.from_pydict(ids | {"x": pa.array([features(t) for t in texts], pa.list_(pa.float64()))})

    got = common.map_arrow(rows.select(F.struct("doc_id", "th", "y").alias("key"), "text"), run, "doc_id long, th long, y long, x array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("th", "ascending")])  # pairs are drawn by place
    return fit(np.array(got["x"].to_pylist(), float).reshape(-1, len(features(""))), np.array(got["y"].to_pylist()))


def scores(model: Ranking, texts: list[str]) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts], float).reshape(len(texts), -1))


def rank(docs: DataFrame, model: Ranking) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, held_out, score, predicted.

    A null text counts as empty and is scored by the features of an empty text. Repeated rows and null doc_ids give rows of their own;
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            s = scores(model, texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": [common.held_out(i) for i in ids], "score": s, "predicted": pa.array((s >= CUT).astype(np.int32))})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of `docs` that the model accepts, with all their columns; null and empty texts are judged like any other."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scores(model, [t or "" for t in batch.column(at).to_pylist()]) >= CUT))

    return common.map_arrow(docs, run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: learn from labels, then score all documents."""
    docs = common.load(spark, sf_dir, "documents")
    return rank(docs, learn(docs, common.load(spark, sf_dir, "labels")))
