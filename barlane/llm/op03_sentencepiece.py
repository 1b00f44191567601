"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

Encoding starts from single characters and keeps an agenda of adjacent symbol pairs whose joined text is a piece. The
pair with the highest score, of equals the leftmost, is merged first, until the agenda is empty. Symbols that are no
piece then become byte pieces. `agenda` does this with a heap for one string of any length in n log n; `agenda_many`
does the same merges for many short strings at once in numpy, one step of every string's agenda at a time.

No piece of such a vocabulary holds a space mark after another character (checked when the model is read), so merges
never cross from a word into the next space: a text is cut there, and each distinct part is encoded once a task
while its cache has room. Characters that are in no longer piece, such as line feeds, cut in the same way, and so does
any neighbouring pair of characters that no piece holds.

Check against the library: the sentencepiece library too encodes every whole text and decodes its ids. Any difference, in
ids or in decoded text, fails the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common

SPACE_MARK = "▁"
#: Parts up to this many characters go through agenda_many.
SHORT = 24
#: Characters of the parts that a worker keeps the ids of during a task, with PART_CHARS more for each part: about 60 MB.
CACHE_CHARS = 12 << 20
PART_CHARS = 24
#: Characters of text that are encoded together.
GROUP_CHARS = 2 << 20
_PARTS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
_NONE = np.int32(2**31 - 1)


class Model:
    """A BPE model file: pieces, their order by score, and which adjacent pieces merge into which."""

    def __init__(self, path: str) -> None:
        common.worker_env()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            data = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        kinds = proto.SentencePiece
        pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.scores = [p.score for p in proto.pieces]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        order = sorted(set(self.scores), reverse=True)
        rank = {s: k for k, s in enumerate(order)}
        self.rank = np.array([rank[s] for s in self.scores], np.int32)
        # Every way to split a piece in two pieces or characters is a merge.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols))
        merges = {(self.symbols[p[:i]], self.symbols[p[i:]]): j for p, j in self.ids.items() for i in range(1, len(p)) if p[:i] in self.symbols and p[i:] in self.symbols}
        self._table(merges)
        self.text_of = [p.replace(SPACE_MARK, " ") for p in pieces]
        for b, i in self.bytes.items():
            self.text_of[i] = chr(b) if b < 128 else ""
        self.high_ids = np.zeros(len(pieces), bool)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for b, i in self.bytes.items():
            self.high_ids[i] = b >= 128
        self.special = {i for i, p in enumerate(proto.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.decimal = [str(i) for i in range(len(pieces))]
        self.forget()
        self.code = "H" if len(pieces) <= 2**16 else "I"

    def forget(self) -> None:
        """Drop the cache: a worker goes on to other tasks, which need not be of this operator."""
        self.cache: dict[str, bytes] = {"": b""}
        self.room = CACHE_CHARS

    def _table(self, merges: dict[tuple[int, int], int]) -> None:
        """Open addressing over (left, right), for lookups of many pairs at once."""
        self.slots = 1 << max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(self.slots, -1, np.int64)
        self.merged = np.zeros(self.slots, np.int32)
        for (a, b), j in merges.items():
            at = int(self._slot(np.array([a << 20 | b], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % self.slots
            self.keys[at], self.merged[at] = a << 20 | b, j

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) % self.slots
        return out

    def byte_ids(self, symbol: str) -> list[int]:
        """A symbol that is no piece, as byte pieces."""
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised text of any length: a heap of (score order, left position) over a linked list."""
        n = len(text)
        start, end = list(range(n)), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n)) + [-1]
        heap: list[tuple[float, int, int, int]] = []
        ids, scores = self.ids, self.scores

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := ids.get(text[start[a] : end[b]])) is not None:
                heapq.heappush(heap, (-scores[i], a, b, end[b] - start[a]))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = [True] * n
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not alive[a] or not alive[b] or after[a] != b or end[b] - start[a] != size:
                continue
            end[a] = end[b]
            alive[b] = False
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out, at = [], 0
        while 0 <= at < n:
            piece = text[start[at] : end[at]]
            i = ids.get(piece)
            out += self.byte_ids(piece) if i is None else [i]
            at = after[at]
        return out

    def agenda_many(self, parts: list[str]) -> list[bytes]:
        """agenda() of many short parts together. Each round makes the first merge of every part's agenda."""
        width = max(map(len, parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = "".join(parts)
        chars = {c: self.symbols.get(c, -2 - k) for k, c in enumerate(set(flat))}
        unknown = {v: c for c, v in chars.items() if v < 0}
        grid = np.full((len(parts), width + 1), -1, np.int32)
        grid[np.arange(width + 1)[None, :] < sizes[:, None]] = np.fromiter(map(chars.__getitem__, flat), np.int32, len(flat))
        for v in {c for c in set(chars.values()) if c >= len(self.scores)}:
            unknown[v] = next(c for c, s in chars.items() if s == v)
        into = np.full((len(parts), width), -1, np.int32)
        ok = (grid[:, :-1] >= 0) & (grid[:, 1:] >= 0)
        into[ok] = self.lookup(grid[:, :-1][ok], grid[:, 1:][ok])
        order = np.where(into >= 0, self.rank[into], _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows, cols = np.arange(len(parts)), np.arange(width + 1)
        while len(rows):
            at = order.argmin(1)
            each = np.arange(len(rows))
            more = order[each, at] < _NONE
            if not more.all():
                done.append((rows[~more], grid[~more]))
                rows, grid, into, order, at = rows[more], grid[more], into[more], order[more], at[more]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            joined = into[each, at]
            shift = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width)
            grid = np.take_along_axis(grid, shift, 1)
            grid[:, -1] = -1
            grid[each, at] = joined
            into = np.take_along_axis(into, shift[:, :-1] % width, 1)
            order = np.take_along_axis(order, shift[:, :-1] % width, 1)
            into[:, -1], order[:, -1] = -1, _NONE
            for where in (at - 1, at):
                inside = where >= 0
                r, w = each[inside], where[inside]
                left, right = grid[r, w], grid[r, w + 1]
                both = (left >= 0) & (right >= 0)
                got = np.full(len(r), -1, np.int32)
                got[both] = self.lookup(left[both], right[both])
                into[r, w] = got
                order[r, w] = np.where(got >= 0, self.rank[got], _NONE)
        out: list[bytes] = [b""] * len(parts)
        n_ids = len(self.scores)
        for which, left in done:
            used = left != -1
            counts = used.sum(1)
            ids = left[used]
            odd = (ids < 0) | (ids >= n_ids)
            data, step = ids.astype(f"<u{2 if self.code == 'H' else 4}").tobytes(), 2 if self.code == "H" else 4
            cuts = np.concatenate([[0], counts.cumsum()]).tolist()
            strange = np.add.reduceat(odd, cuts[:-1]).tolist() if len(ids) else []
            for k, row in enumerate(which.tolist()):
                if strange[k]:
                    out[row] = array(self.code, [i for v in ids[cuts[k] : cuts[k + 1]].tolist() for i in (self.byte_ids(unknown[v]) if v in unknown else [v])]).tobytes()
                else:
                    out[row] = data[cuts[k] * step : cuts[k + 1] * step]
        return out

    def split(self, text: str) -> list[str]:
        """The parts of a raw text that are encoded on their own."""
        if not text:
            return []
        text = " " + text
        if SPACE_MARK in text or "  " in text:
            return _PARTS.findall(text.replace(" ", SPACE_MARK))
        return text.replace(" ", f" {SPACE_MARK}").replace("\n", " \n ").split(" ")

    def _cut(self, part: str) -> tuple[str, str]:
        """A part's last character apart, if no piece joins it to what stands before."""
        return (part[:-1], part[-1]) if len(part) > 2 and part[-2:] not in self.bigrams else (part, "")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole raw texts as little-endian integers; all are checked against the library."""
        split = [self.split(t) for t in texts]
        cache = self.cache
        cut = {p: self._cut(p) for p in set().union(*split).difference(cache)}
        new = list({x for pair in cut.values() for x in pair}.difference(cache))
        short = [p for p in new if len(p) <= SHORT]
        found: dict[str, bytes] = {}
        for low, high in ((1, 10), (11, SHORT)):
            some = [p for p in short if low <= len(p) <= high]
            for at in range(0, len(some), 1 << 15):
                run = some[at : at + (1 << 15)]
                found.update(zip(run, self.agenda_many(run), strict=True))
        for p in new:
            if len(p) > SHORT:
                found[p] = array(self.code, self.agenda(p)).tobytes()
        for part, (stem, last) in cut.items():
            if last:
                found[part] = (found[stem] if stem in found else cache[stem]) + (found[last] if last in found else cache[last])
        cache.update(found)
        out = [b"".join(map(cache.__getitem__, parts)) for parts in split]
        for p in [p for p in found if len(p) > 2 * SHORT]:
            del cache[p], found[p]
        weight = sum(map(len, found)) + PART_CHARS * len(found)
        if weight > self.room:
            for p in found:
                del cache[p]
        else:
            self.room -= weight
        self._check(texts, out)
        return out

    def _check(self, texts: list[str], encoded: list[bytes]) -> None:
        """Hold the ids of whole texts against the library's."""
        for text, data in zip(texts, encoded, strict=True):
            if array(self.code, self.library.encode(text)).tobytes() != data:
                raise AssertionError(f"the library encodes a text otherwise: {text[:80]!r}")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Runs of byte pieces that are no UTF-8 give a replacement character a byte."""
        listed = ids.tolist()
        if not len(ids):
            return ""
        if self.high_ids[ids].any() or self.special.intersection(listed):
            return self.library.decode(listed) if self.special.intersection(listed) else self._decode_bytes(listed)
        text = "".join(map(self.text_of.__getitem__, listed))
        return text[1:] if listed[0] not in self.byte_of and text.startswith(" ") else text

    def _decode_bytes(self, listed: list[int]) -> str:
        out, run = [], bytearray()
        for i in listed:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run = bytearray()
            out.append(self.text_of[i])
        out.append(_utf8(bytes(run)))
        text = "".join(out)
        return text[1:] if listed[0] not in self.byte_of and text.startswith(" ") else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of this worker; it stays from task to task, its cache does not."""
    if path not in _models:
        _models.clear()
        _models[path] = Model(path)
    return _models[path]


def digests(m: Model, texts: list[str]) -> Iterator[tuple[bytes, str, str]]:
    """For each text: its ids as bytes, the sha256 of the decimal ids joined by commas, and that of the decoded text."""
    width = 2 if m.code == "H" else 4
    for text, data in zip(texts, m.encode(texts), strict=True):
        ids = np.frombuffer(data, f"<u{width}")
        decoded = m.decode(ids)
        if m.library.decode(ids.tolist()) != decoded:
            raise AssertionError(f"the library decodes a text otherwise: {text[:80]!r}")
        yield data, hashlib.sha256(",".join(map(m.decimal.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, n_tokens, ids_sha256, decoded_sha256, and
    with `with_ids` also ids (array of int).

    A null text counts as empty and has no ids: n_tokens 0 and the digests of the empty string. Repeated rows and a
    null doc_id give rows of their own. An empty table gives no rows. No row moves between tasks; texts are taken
    together up to GROUP_CHARS characters, so a worker holds no more than these and its cache.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        try:
            yield from encoded(m, batches)
        finally:
            m.forget()

    def encoded(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if m.code == "H" else 4
        for ids, texts in common.grouped(batches, GROUP_CHARS):
            got = list(digests(m, texts))
            cols = [pa.array(ids, pa.int64()), pa.array([len(d) // width for d, _, _ in got], pa.int64()), pa.array([a for _, a, _ in got], pa.string()), pa.array([b for _, _, b in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(d, f"<u{width}").astype(np.int32) for d, _, _ in got], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    import public_tokenizers

    return encode_documents(common.load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
