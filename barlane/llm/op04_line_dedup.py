"""Line dedup by a sharded minimal perfect hash.

1. Every document's lines become keys (stripped, A-Z lowered) and those of LEAST_CHARS code points or more a 128-bit
   hash; per document and key one small row goes to the shared folder: hash, document, line numbers.
2. These are counted by hash: documents, and the largest doc_id. Tasks count first, so a line in a third of all
   documents moves as one row a task.
3. Distinct hashes are dealt to shards of about SHARD_KEYS. A shard gets a minimal perfect hash over its keys
   (levels of bit arrays; a key's place is the rank of its bit), which indexes three flat arrays: a 32-bit
   fingerprint, the count of documents (up to 255, or to least_docs if that is more) and the largest doc_id.
4. Documents' hashes are dealt to the same shards and probe the arrays; no lines are joined. A shard with more than
   PROBE_ROWS probes, because one line is everywhere, is split into that many parts, salted by document, text and where its row is read, each
   with a copy of the shard's arrays.
5. The line numbers to drop go back to their documents, by doc_id and hash of text.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARD_KEYS = 1 << 15
PROBE_ROWS = 1 << 16
#: Documents of a line that are counted at least, in one byte.
MOST_COUNT = 255
#: Bytes of a line's row, and of such rows in a partition.
ROW_BYTES = 64
PARTITION_BYTES = 8 << 20
#: Bits a key of each level of the hash.
GAMMA = 2.0
LEVELS = 32
_SPACE = common.SPACE.encode()
_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + _U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: 0 .. n-1, without the keys.

    Level l has a bit for each of about GAMMA times the keys left. A key alone at its bit sets it; keys that meet go
    on to the next level. The few that meet at every level are kept in order and found by bisection.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.bitwise_count(bits)
        self.before = np.concatenate([[0], words.cumsum(dtype=np.int64)])
        self.n = int(self.before[-1]) + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys.astype(np.uint64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, math.ceil(GAMMA * len(left)) + 63 & ~63)
            at = (mix(left, level + 1) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.empty(0, np.uint64), np.sort(left))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 or any number for keys that are not in the set."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = (mix(keys[todo], level + 1) % _U(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & _U(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[todo[hit]] = self.before[w] + np.bitwise_count(self.bits[w] & ((_U(1) << b) - _U(1)))
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            place = np.searchsorted(self.rest, keys[todo])
            ok = (place < len(self.rest)) & (self.rest[np.minimum(place, len(self.rest) - 1)] == keys[todo])
            out[todo[ok]] = self.n - len(self.rest) + place[ok]
        return out


class Shard:
    """A shard's perfect hash and arrays, and its form as bytes."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.hash, self.prints, self.counts, self.last = hash_, prints, counts, last

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n_docs: np.ndarray, last: np.ndarray, most: int = MOST_COUNT) -> Shard:
        """Counts are exact up to `most`, which larger ones are stored as; it decides how wide they are."""
        keys = cls.key(h1, h2)
        hash_ = PerfectHash.build(keys)
        at = hash_(keys)
        prints, counts, ids = np.zeros(hash_.n, np.uint32), np.zeros(hash_.n, np.min_scalar_type(most)), np.zeros(hash_.n, np.int64)
        prints[at], counts[at], ids[at] = h2.astype(np.int64).view(np.uint64).astype(np.uint32), np.minimum(n_docs, most), last
        return cls(hash_, prints, counts, ids)

    @staticmethod
    def key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return h1.astype(np.int64).view(np.uint64) ^ mix(h2.astype(np.int64).view(np.uint64), 99)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest doc_id) of each hash; 0 documents if the fingerprint differs."""
        at = self.hash(self.key(h1, h2))
        ok = (at >= 0) & (self.prints[at] == h2.astype(np.int64).view(np.uint64).astype(np.uint32))
        return np.where(ok, self.counts[at], 0), self.last[at]

    def to_bytes(self) -> bytes:
        h = self.hash
        head = struct.pack(f"<IIII{len(h.sizes)}I", len(h.sizes), h.n, len(h.rest), self.counts.itemsize, *h.sizes)
        return head + h.bits.tobytes() + h.rest.tobytes() + self.prints.tobytes() + self.counts.tobytes() + self.last.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        levels, n, rest, width = struct.unpack_from("<IIII", data)
        sizes = list(struct.unpack_from(f"<{levels}I", data, 16))
        at = 16 + 4 * levels

        def take(kind: type | str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        hash_ = PerfectHash(sizes, take(np.uint64, sum(sizes) // 64), take(np.uint64, rest))
        return cls(hash_, take(np.uint32, n), take(f"u{width}", n), take(np.int64, n))


def line_keys(text: str, least: int) -> list[tuple[bytes, int]]:
    """(key, line number) of the lines whose keys have `least` code points or more."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if len(line) >= least:
            line = line.strip(common.SPACE)
            if len(line) >= least:
                out.append((line.encode("utf-8", "surrogatepass").lower(), i))
    return out


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, did, th, lines: per document and distinct key its 128-bit hash and line numbers."""
    rows = docs.select(common.fold(F.col("doc_id")).alias("did"), F.col("text"), F.xxhash64("text").alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            h, dids, ths, lines = [], [], [], []
            for did, text, th in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: dict[bytes, list[int]] = {}
                for key, i in line_keys(text or "", least):
                    found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                h += found
                lines += found.values()
                dids += [did] * len(found)
                ths += [th] * len(found)
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(dids, pa.int64()), pa.array(ths, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], ["h1", "h2", "did", "th", "lines"])

    return common.map_arrow(rows, run, "h1 long, h2 long, did long, th long, lines array<int>")


def build_index(lines: DataFrame, n_shards: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """shard, probes, data: the shards' arrays, from hashed_lines(), with counts that can be held against least_docs."""
    most = max(MOST_COUNT, least_docs)
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("did").alias("n"), F.max("did").alias("last"), F.count(F.lit(1)).alias("probes"))
    n_parts = common.parts_of(lines.sparkSession, n_shards * SHARD_KEYS * ROW_BYTES, PARTITION_BYTES)
    counted = counted.withColumn("shard", F.pmod("h1", F.lit(n_shards))).repartition(n_parts, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def close() -> pa.RecordBatch:
            h1, h2, n, last, probes = (np.concatenate([p[i] for p in parts]) for i in range(5))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "probes": pa.array([int(probes.sum())], pa.int64()), "data": pa.array([Shard.build(h1, h2, n, last, most).to_bytes()], pa.binary())})

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            edges = [0, *(np.flatnonzero(np.diff(cols[5])) + 1).tolist(), len(cols[5])]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if parts and cols[5][a] != shard:
                    yield close()
                    parts = []
                shard = int(cols[5][a])
                parts.append([c[a:b].copy() for c in cols[:5]])
        if parts:
            yield close()

    return common.map_arrow(counted.select("h1", "h2", "n", "last", "probes", "shard"), run, "shard long, probes long, data binary")


def probe(lines: DataFrame, index: DataFrame, n_shards: int, least_docs: int) -> DataFrame:
    """did, th, lines: the line numbers to drop, from hashed_lines() and the shards."""
    salts = F.ceil(F.col("probes") / PROBE_ROWS).cast("int")
    hot = index.where(F.col("probes") > PROBE_ROWS).select("shard", salts.alias("salts"))
    asked = lines.withColumn("shard", F.pmod("h1", F.lit(n_shards))).join(hot, "shard", "left")
    asked = asked.select("shard", F.coalesce(F.pmod(F.xxhash64("did", "th", F.spark_partition_id()), F.col("salts").cast("long")), F.lit(0)).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "did", "th", "lines", F.lit(None).cast("binary").alias("data"))
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "did", "th")), F.lit(None).cast("array<int>").alias("lines"), "data")
    n_parts = common.parts_of(lines.sparkSession, n_shards * SHARD_KEYS * ROW_BYTES, PARTITION_BYTES)
    both = asked.unionByName(arrays).repartition(n_parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(kinds == 0).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    shard = Shard.from_bytes(part.column("data")[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                h1, h2, did = (part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "did"))
                n, last = shard.probe(h1, h2)
                if (n == 0).any():
                    raise AssertionError("a line's hash is not in its shard")
                go = pa.array((n >= least_docs) & (did != last))
                part = part.select(["did", "th", "lines"]).filter(go)
                if part.num_rows:
                    yield part

    return common.map_arrow(both, run, "did long, th long, lines array<int>")


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, name: str = "line_dedup") -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept_text in one struct column `name`; all other columns stay as they are,
    and one of that name gives way.

    A null or empty text is one empty line and stays. Keys shorter than `least_chars` never go. Rows that share a
    doc_id count as one document, and so do rows whose doc_id is null, which is never the largest beside others; in
    all rows of the largest doc_id the lines stay, and repeats of a line inside that document too. Repeated rows are
    all returned. An empty table gives none.
    """
    with common.workspace(docs.sparkSession, "line-dedup") as keep:
        lines = common.written(hashed_lines(docs, least_chars), "hashes")
        n_shards = max(1, -(-lines.count() // SHARD_KEYS))
        index = common.written(build_index(lines, n_shards, least_docs), "index")
        drops = probe(lines, index, n_shards, least_docs).distinct()
        drops = keep(drops.groupBy("did", "th").agg(F.flatten(F.collect_list("lines")).alias("gone")), "line-drops")
    kept_columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()))
    keyed = docs.select(kept_columns.alias("row"), F.coalesce("text", F.lit("")).alias("body"), common.fold(F.col("doc_id")).alias("did"), F.xxhash64("text").alias("th"))
    joined = keyed.join(drops, ["did", "th"], "left")
    common.small_batches(docs.sparkSession)
    common.ship(docs.sparkSession)
    body, gone = F.col("body"), F.col("gone")
    out = F.struct(
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.coalesce(without_lines()(F.when(gone.isNotNull(), body), gone), body).alias("kept_text"),
    )
    return joined.select("row", out.alias("found")).select("row.*", F.col("found").alias(name))


def without_lines() -> Callable[[Column, Column], Column]:
    """A text without the lines of the given numbers; null where there are none. Its work grows with the text alone."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, numbers in zip(texts, gone, strict=True):
            if not numbers.is_valid:
                out.append(None)
                continue
            drop = set(numbers.as_py())
            out.append("\n".join(line for i, line in enumerate(text.as_py().split("\n")) if i not in drop))
        return pa.array(out, pa.string())

    return cut


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    got = dedup(docs)
    return got.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), keys AS (
    SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.*, keys.k IS NOT NULL AND l.doc_id <> keys.last AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
