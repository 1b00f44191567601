"""Token-ID output as sorted-string-table shards.

A shard file holds the token ids of documents in ascending doc_id order:

    block*  index  bloom  footer

Block: records `varint shared, varint unshared, varint value bytes, key suffix, value`. A key is the doc_id as 8
big-endian bytes with the sign bit flipped, so byte order is number order; `shared` bytes are taken over from the
key before, except at restart points every RESTART records, whose offsets (u32) and count (u32) close the block.
A value is the ids as little-endian unsigned integers of `width` bytes (2 where all ids fit, else 4).
Index: per block its last key, offset (u64) and length (u32). Bloom: bits over the keys, 10 a key, 7 probes.
Footer (fixed length, at the end): offsets, lengths and counts of all these, a crc32 of index and bloom, and a magic.

`get` reads the footer, asks the Bloom filter, bisects the index for one block and bisects its restart points.

Documents are dealt to shards by range of (doc_id, hash of text, number of the row), so one doc_id that repeats very
often still spreads, and so does one row.
Each task sorts its range, encodes and writes block by block; only the block, the sparse index and the keys' hashes
stay in memory. A file gets its final name by a rename after it is whole, so a lost executor's task just runs again.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

MAGIC = b"SSTB0001"
FOOTER = struct.Struct("<QQQQQQIIII8s")
INDEX = struct.Struct("<8sQI")
RESTART = 16
BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10
BLOOM_PROBES = 7
#: Bytes of the input's files that one shard takes.
SHARD_BYTES = 32 << 20
#: Marks that words of letters often end with; one text in CHECKED is encoded whole too.
MARKS, CHECKED = ".,!?;:", 32
#: Entries of a worker's word cache, and the longest word it keeps.
CACHE_WORDS = 1_000_000
CACHE_CHARS = 40
READ_ROWS = 1024
#: Characters of text that are encoded together.
GROUP_CHARS = 2 << 20


def key_bytes(doc_id: int | None) -> bytes:
    """A doc_id as bytes whose order is the order of numbers. A null doc_id counts as the smallest long."""
    return struct.pack(">Q", (common.NO_ID if doc_id is None else doc_id) + 2**63)


def key_id(key: bytes) -> int | None:
    doc_id = struct.unpack(">Q", key)[0] - 2**63
    return None if doc_id == common.NO_ID else doc_id


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_probes(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit numbers, one row a probe, from 64-bit hashes by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[None, :] + np.arange(BLOOM_PROBES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(n_bits)


def key_hashes(ids: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of doc_ids."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Writer:
    """Writes one shard to a binary stream; keys must come in ascending order, and may repeat."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES) -> None:
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.block, self.restarts, self.last, self.in_block = bytearray(), [], b"", 0
        self.index, self.ids, self.offset, self.n_ids = [], array("q"), 0, 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_bytes(doc_id)
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.in_block += 1
        self.ids.append(common.NO_ID if doc_id is None else doc_id)
        self.n_ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        self.block += struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        self.index.append(INDEX.pack(self.last, self.offset, len(self.block)))
        self.out.write(bytes(self.block))
        self.offset += len(self.block)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> dict:
        self._flush()
        index = b"".join(self.index)
        n_bits = max(64, len(self.ids) * BLOOM_BITS + 7 & ~7)
        bits = np.zeros(n_bits, np.uint8)
        if len(self.ids):
            hashes = key_hashes(np.frombuffer(self.ids, np.int64))
            for probe in bloom_probes(hashes, n_bits):
                bits[probe.astype(np.int64)] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.ids), self.n_ids, n_bits, BLOOM_PROBES, self.width, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))
        return {"n_docs": len(self.ids), "n_ids": self.n_ids}


class Reader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - FOOTER.size)
        (self.index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.n_bits, self.probes, self.width, crc, magic) = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(self.index_at)
        index = file.read(index_len)
        self.bloom = file.read(bloom_len)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("the index or the Bloom filter is damaged")
        self.entries = list(INDEX.iter_unpack(index))
        self.last_keys = [e[0] for e in self.entries]
        self.blocks_read = 0

    def _block(self, i: int) -> bytes:
        self.blocks_read += 1
        self.file.seek(self.entries[i][1])
        return self.file.read(self.entries[i][2])

    @staticmethod
    def _records(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(block) - 4 - 4 * struct.unpack_from("<I", block, len(block) - 4)[0]
        key = b""
        while at < end:
            shared, at = get_varint(block, at)
            unshared, at = get_varint(block, at)
            length, at = get_varint(block, at)
            key = key[:shared] + block[at : at + unshared]
            at += unshared
            yield key, block[at : at + length]
            at += length

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        """All (doc_id, value) in order."""
        for i in range(len(self.entries)):
            for key, value in self._records(self._block(i)):
                yield key_id(key), value

    def may_contain(self, doc_id: int | None) -> bool:
        probes = bloom_probes(key_hashes(np.array([common.NO_ID if doc_id is None else doc_id])), self.n_bits)[:, 0]
        return all(self.bloom[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in probes)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first row with this doc_id, or None: Bloom filter, index, restart points, then a short scan."""
        if not self.may_contain(doc_id):
            return None
        key = key_bytes(doc_id)
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.entries):
            return None
        block = self._block(i)
        n = struct.unpack_from("<I", block, len(block) - 4)[0]
        restarts = struct.unpack_from(f"<{n}I", block, len(block) - 4 - 4 * n)
        low = bisect.bisect_left(restarts, key, key=lambda at: next(self._records(block, at))[0])
        for found, value in self._records(block, restarts[max(0, low - 1)]):
            if found >= key:
                return self.ids(value) if found == key else None
        return None

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library that drops white space between words.

    For such a tokenizer the ids of a text are those of its words one after another, so each distinct word is
    encoded once a worker while the cache has room. Words of letters go to the library many at once, joined by
    spaces; the ends of words in its answer are the tokens that carry the model's word-end suffix. If their count
    is not the count of words, these words are encoded one by one. A mark after a word of letters is encoded apart if the
    tokenizer does so. A tokenizer without these properties encodes whole texts. One text in CHECKED, by its
    length and place, is encoded whole too, and a difference fails the job.
    """

    def __init__(self, path: str) -> None:
        common.worker_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(True)
        self.width = 2 if size <= 2**16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        probe = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = bool(suffix) and probe("ab cde\nf, g") == [i for w in ("ab", "cde", "f,", "g") for i in probe(w)]
        #: Marks that are never joined with the word before them.
        self.apart = "".join(m for m in MARKS if all(probe(w + m) == probe(w) + probe(m) for w in ("a", "the", "abc", "hello", "zqxj", "é")))
        if self.by_word:
            self.ends = np.zeros(size, bool)
            for token, i in self.tokenizer.get_vocab(True).items():
                self.ends[i] = token.endswith(suffix)
        self.code = "H" if self.width == 2 else "I"
        self.cache: dict[str, bytes] = {"": b""}

    def _each(self, words: list[str]) -> list[bytes]:
        out = []
        for run in common.chunks(words, map(len, words), 1 << 18):
            out += [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        out = []
        for at in range(0, len(words), 4096):
            run = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(run):
                out += self._each(run)
                continue
            data, cuts = ids.tobytes(), (ends * self.width).tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of `width` bytes."""
        if not self.by_word:
            return self._each(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(self.cache))
        letters, other, cut = [], [], []
        for w in new:
            if w.isalpha():
                letters.append(w)
            elif w[-1] in self.apart and w[:-1].isalpha():
                cut.append(w)
            else:
                other.append(w)
        stems = set(w[:-1] for w in cut).difference(self.cache, letters)
        letters += stems
        found = dict(zip(letters, self._letters(letters), strict=True)) | dict(zip(other, self._each(other), strict=True))
        marks = {w[-1] for w in cut}.difference(self.cache, found)
        found |= dict(zip(marks, self._each(list(marks)), strict=True))
        cache = self.cache
        for w in cut:
            stem, mark = w[:-1], w[-1]
            found[w] = (found[stem] if stem in found else cache[stem]) + (found[mark] if mark in found else cache[mark])
        room = CACHE_WORDS - len(cache)
        cache.update(found)
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in found if room < len(found) else [w for w in found if len(w) > CACHE_CHARS]:
            del cache[w]
        for i, (text, got) in enumerate(zip(texts, out, strict=True)):
            if (i + len(text)) % CHECKED == 0 and self._each([text])[0] != got:
                raise AssertionError(f"a text's ids differ from those of its words: {text[:80]!r}")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker; it keeps its cache from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int, n_shards: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text; other columns are left out) and write its shards under `out_uri`.

    Null texts count as empty: such a document holds the end id alone. A null doc_id sorts first. Rows that repeat
    a doc_id are all kept, in the order of their text's hash. An empty table writes no shard. Returns the manifest:
    shard, path, n_docs, n_ids, and the first and last doc_id.
    """
    n = n_shards or common.parts_for(docs, SHARD_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "k": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h", "k").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h", "k")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        end = array(enc.code, [end_id]).tobytes()
        fs, root = common.filesystem(out_uri)
        path, writer, stream, first = f"{root}/shard-{shard:07d}.sst", None, None, None
        part = f"{root}/.shard-{shard:07d}-{uuid.uuid4().hex}"
        for doc_ids, texts in common.grouped(batches, GROUP_CHARS):
            if writer is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(part)
                writer, first = Writer(stream, enc.width), doc_ids[0]
            for doc_id, ids in zip(doc_ids, enc.texts(texts), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            info = writer.close()
            stream.close()
            fs.move(part, path)
            ends = {"first": pa.array([first], pa.int64()), "last": pa.array([doc_ids[-1]], pa.int64())}
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [info["n_docs"]], "n_ids": [info["n_ids"]]} | ends)

    manifest = common.written(common.map_arrow(rows, write, "shard long, path string, n_docs long, n_ids long, first long, last long"), "sst-manifest")
    sweep(docs.sparkSession, out_uri)
    return manifest


def sweep(spark: SparkSession, out_uri: str) -> None:
    """Delete what tasks that failed or were lost have left unfinished beside the shards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, ".shard-*")) or ():
        fs.delete(left.getPath(), False)


def read_shards(spark: SparkSession, manifest: DataFrame, out_uri: str) -> DataFrame:
    """All documents of the shards: doc_id, start, n_tokens, ids_crc32. A start counts all ids of documents before it.

    The driver takes three numbers a shard, to add up where each shard starts.
    """
    rows, start = [], 0
    for r in manifest.select("shard", "path", "n_ids").orderBy("shard").collect():
        rows.append((r["path"], start))
        start += r["n_ids"]
    todo = spark.createDataFrame(rows, "path string, start long")
    todo = todo.repartition(max(1, min(len(rows), 100_000)), "path") if rows else todo

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.filesystem(out_uri)
        _encoders.clear()  # the shards are written: their cache goes
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    reader = Reader(file, file.size())
                    yield from _digests(reader, at)

    return common.map_arrow(todo, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(reader: Reader, at: int) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    out: list[tuple] = []
    for doc_id, value in reader.scan():
        ids = reader.ids(value)
        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
        if len(out) >= READ_ROWS:
            yield _batch(out, names)
            out = []
    if out:
        yield _batch(out, names)


def _batch(rows: Iterable[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))


def directory(manifest: DataFrame) -> list[tuple[str, bytes, bytes]]:
    """(path, first key, last key) of each shard, in order; five numbers and a path a shard, for lookup()."""
    rows = manifest.select("path", "first", "last").orderBy("shard").collect()
    return [(r["path"], key_bytes(r["first"]), key_bytes(r["last"])) for r in rows]


def lookup(out_uri: str, shards: list[tuple[str, bytes, bytes]], doc_id: int | None) -> np.ndarray | None:
    """One document's ids, by bisection over the keys of directory()'s shards, then over that shard's index. A doc_id in
    several rows gives the first. No other shard is opened."""
    key = key_bytes(doc_id)
    fs, _ = common.filesystem(out_uri)
    for path, first, _ in shards[bisect.bisect_left(shards, key, key=lambda s: s[2]) :]:
        if first > key:
            break
        with fs.open_input_file(path) as file:
            found = Reader(file, file.size()).get(doc_id)
            if found is not None:
                return found
    return None


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents, written as shards to the shared folder and read back from them."""
    import public_tokenizers

    out = common.scratch(spark, "op1-shards")
    manifest = write_shards(common.load(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_shards(spark, manifest, out)
