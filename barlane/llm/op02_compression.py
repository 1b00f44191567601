"""Quality rules: compression bands.

A text's zstandard ratio (compressed bytes / bytes, level 3) is taken over the whole text and over fixed chunks of
CHUNK bytes. Repetitive text compresses too well, random text too badly. Short texts compress worse than long ones, so
the limits depend on the length: BANDS holds for whole texts, CHUNK_BAND for chunks, of which at most a share may lie
outside. A last chunk too short for its limits is judged with the chunk before it. Counts of words, symbols, repeated lines and repeated 8-word windows come along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

LEVEL = 3
CHUNK = 4096
#: Bytes of a last chunk that is judged by itself.
LEAST_CHUNK = 1024
#: (bytes below which the limits hold, lowest ratio, highest ratio).
BANDS = (
    (256, 0.30, 1.10),
    (512, 0.28, 0.95),
    (1024, 0.25, 0.90),
    (2048, 0.24, 0.85),
    (4096, 0.22, 0.80),
    (16384, 0.20, 0.75),
    (float("inf"), 0.18, 0.75),
)
CHUNK_BAND = (0.20, 0.85)
#: Share of chunks that may be outside their band.
CHUNK_SHARE = 0.25
WINDOW = 8
SYMBOLS = "#*$%&|<>"
GROUP_CHARS = 2 << 20


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more, exactly.

    Equal windows have equal hashes, so texts without a repeated hash are done; else the words of windows with
    repeated hashes are compared.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    step, mixed = 1, h
    while step < window:  # window is a power of two
        mixed = (mixed[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step)) + (mixed[step:] ^ (mixed[step:] >> np.uint64(29)))
        step *= 2
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((edge.cumsum()[:-1] > 0).sum())


def count(text: str) -> Counts:
    """The base counts of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(common.SPACE)]
    return Counts(
        len(words),
        len(text) - sum(map(text.count, common.SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def base_failed(c: Counts) -> bool:
    return c.n_words < 20 or 100 * c.n_repeat_words > 30 * c.n_words


def chunks(data: bytes) -> list[bytes]:
    """All of `data` in chunks of CHUNK bytes; a last one shorter than LEAST_CHUNK is joined to the one before it."""
    starts = range(0, max(len(data) - LEAST_CHUNK + 1, 1), CHUNK)
    return [data[i : i + CHUNK] for i in starts[:-1]] + [data[starts[-1] :]]


class Bands:
    """The method's verdict; holds a compressor, so one for each worker."""

    def __init__(self) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress

    def __call__(self, text: str) -> tuple[float | None, float | None, bool]:
        """(ratio of the whole, share of chunks out of their band, accepted). An empty text has no ratio and is rejected."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return None, None, False
        ratio = len(self.compress(data)) / len(data)
        low, high = next((low, high) for most, low, high in BANDS if len(data) < most)
        out = None
        if len(data) > CHUNK:
            parts = chunks(data)
            out = sum(not CHUNK_BAND[0] <= len(self.compress(p)) / len(p) <= CHUNK_BAND[1] for p in parts) / len(parts)
        return ratio, out, low <= ratio <= high and (out is None or out <= CHUNK_SHARE)


def judge(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out) the counts, base_failed, kept, ratio and
    chunks_out.

    A null text counts as empty: no words, base_failed, not kept, null ratio. Repeated rows and null doc_ids give rows
    of their own; an empty table gives none. Rows stay in their tasks.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_out double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                c, (ratio, out, ok) = count(text), bands(text)
                failed = base_failed(c)
                rows.append((doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, ok and not failed, ratio, out))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return judge(common.load(spark, sf_dir, "documents"))
