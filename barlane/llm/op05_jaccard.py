"""N-gram Jaccard join: size-aware, heavy-light.

A document's set is its distinct word shingles; two documents link when the Jaccard similarity of their sets reaches a
threshold. Equal sets are one node, by a 128-bit fingerprint, so copies cost nothing further.

Order. Shingles are ordered rarest first: those that many documents hold (found by counting in every task, all
documents) come last, by their count; the others by the length of their words, longest first, then by hash. Two sets that link share at least
c shingles among the first n - ceil(threshold * n) + c of each.

Light sets, of `boundary` shingles or fewer, enumerate all pairs (fixed-size subsets, c = 2) of that prefix; light sets
that link share such a pair. Heavy sets, and light ones near enough in size to link with them, go to the inverted lists
of their prefix's shingles (c = 1). The boundary is the one with the least cost of writing and scanning
both kinds of lists, by the sizes of all sets and the lengths of a hashed part of the lists of each kind.

Lists. Sets in the same list are candidates. Equal lists count once. No list is expanded to all its pairs: for each set
there are counts of its shingles by hash, a count for two to ten shingles, and the sum of their differences is a lower
bound of how many shingles two sets do not share, which rules out nearly all unlike candidates without their sets. The pairs that are
left are verified on the sets. A list with more of them than DENSE for each of its sets is a group of near copies:
there each set picks its nearest candidate first, and once components are known its nearest few outside its own. The
last round takes all that are left across components, so every link that could join two components has been looked
at. A list of more than PART sets is scanned by several tasks, each for some of its sets against all.

Exactness: shingles are 64-bit numbers (58 of a hash, 6 of the length), and pairs are verified on all of them. Sets are named by
64 bits of a 128-bit fingerprint; where two sets share these, both get new names from all 128.

Partitions: list entries, the largest shuffle, are dealt to as many partitions as their bytes fill, not to more, since a document's
entries that go to one partition compress together. Their number follows from the sizes of all sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.llm import common, shingles
from barlane.llm.components import components

GROUP_CHARS = 2 << 20
#: Shingles counted together in a task, and how many of them must be equal to be reported as frequent.
COUNTED = 1 << 20
REPORTED = 3
#: Frequent shingles that are put last in the order, at most; they go to every task (8 MB).
FREQUENT = 1 << 20
#: Least and most buckets of a set's counts, which are a power of two.
BUCKETS = (64, 8192)
#: One list in so many, by the hash of its key, is measured for the cost of scanning.
MEASURED = 64
#: Subsets of a set up to which it can be light, unless told otherwise; larger sets go to the inverted lists, which are exact for all.
#: What scanning lists of subsets costs is measured on sets of that many.
MOST_SUBSETS = 15
#: What a candidate met while scanning costs, in list entries written: its counts move and are compared (190 bytes to 24).
SCAN_COST = 8
#: Bytes of a list entry, and of entries in a partition.
ENTRY_BYTES = 24
PARTITION_BYTES = 64 << 20
#: Bytes that one row of a list with its counts takes at least, and of such rows in a partition, which are compared with each other.
ROW_BYTES = 256
COMPARED_BYTES = 16 << 20
#: Sets of a list that one task takes as picking ones.
PART = 2048
#: Candidates for each set of a list above which the list is dense.
DENSE = 4
#: Candidates that a set of a dense list picks in each round; None: all.
ROUNDS = (1, 2, None)
#: One round over all candidates, while no components are known: it verifies the links inside components too.
EVERY_LINK = (None,)
NUMERIC_ROWS = 2000
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingle size in words and the similarity num/den."""

    size: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, n: int, c: int = 1) -> int:
        return min(n, n - -(-self.num * n // self.den) + c)

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """How many shingles two linked sets with `total` shingles together may not share."""
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def lonely(self, n: int) -> bool:
        """Whether a set of n shingles can link with equal sets only."""
        return n * self.den // self.num == n and -(-self.num * n // self.den) == n


def buckets(n: int, rule: Rule) -> int:
    """How many counts a set of n shingles has. Unlike sets differ by about the root of n * buckets, linked ones by their
    share of n at most: the more a rule lets linked sets differ, the more counts it takes to tell them apart."""
    share = 2 * (rule.den - rule.num) / (rule.den + rule.num)
    return min(BUCKETS[1], max(BUCKETS[0], 1 << int(9 * share * share * n).bit_length()))


def hashed_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of two kinds. 0: a document's did, th (hash of its text), n, f1, f2 (fingerprint), sig (counts by bucket) and hashes. 1: a shingle
    (f1) that n of the shingles counted together in a task were."""
    schema = "kind byte, did long, th long, n long, f1 long, f2 long, sig binary, hashes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int8(), *[pa.int64()] * 5, pa.binary(), pa.binary()]

    def rows_of(kind: int, **cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)) if c == "kind" else pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = shingles.Hasher()
        seen: list[np.ndarray] = []
        total = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            often = counts >= REPORTED
            return rows_of(1, f1=values[often].view(np.int64), n=counts[often])

        for ids, texts in common.grouped(batches, GROUP_CHARS):
            n, f, sig, packed = [], [], [], []
            listed = [shingles.words(t) for t in texts]
            for ws, h in zip(listed, hasher.words(listed), strict=True):
                s = shingles.rare_first(ws, h, rule.size)
                n.append(len(s))
                f.append(xxhash.xxh3_128_digest(s.tobytes()))
                b = buckets(len(s), rule)
                sig.append(np.minimum(np.bincount((s % _U(b)).astype(np.int64), minlength=b), 255).astype(np.uint8).tobytes())
                packed.append(s.tobytes())
                seen.append(s)
                total += len(s)
            f = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
            yield rows_of(0, did=[i["did"] for i in ids], th=[i["th"] for i in ids], n=n, f1=f[:, 0], f2=f[:, 1], sig=sig, hashes=packed)
            if total >= COUNTED:
                yield counted()
                seen, total = [], 0
        if seen:
            yield counted()

    return common.map_arrow(docs.select(F.struct(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th")), "text"), run, schema)


def subsets(n: int, rule: Rule) -> int:
    """How many subsets a set of n shingles enumerates."""
    return rule.prefix(n, 2) * (rule.prefix(n, 2) - 1) // 2


def boundary(sizes: list[tuple[int, int]], light_scan: float, heavy_scan: float, rule: Rule, most_subsets: int | None = MOST_SUBSETS) -> int:
    """The size up to which sets enumerate subsets, from (size, sets) pairs and what scanning costs for each entry of
    the two kinds of lists, in entries written; of sizes with `most_subsets` or fewer, or of all for None."""
    by_size = sorted(sizes)
    if not by_size:
        return 0
    at = [n for n, _ in by_size]
    lights = np.cumsum([k * subsets(n, rule) * (1 + light_scan) for n, k in by_size])
    heavies = np.cumsum([k * rule.prefix(n) * (1 + heavy_scan) for n, k in by_size])
    best, least = 0, heavies[-1]
    for i, x in enumerate(at):
        if most_subsets is not None and subsets(x, rule) > most_subsets:
            break
        first = int(np.searchsorted(at, x * rule.num / rule.den, side="right")) if x < at[-1] else len(at)
        cost = lights[i] + heavies[-1] - (heavies[first - 1] if first else 0)
        if cost < least:
            best, least = x, cost
    return best


def list_entries(sets: DataFrame, frequent: np.ndarray, light: int, rule: Rule, measure: bool = False, most_subsets: int | None = MOST_SUBSETS) -> DataFrame:
    """key, f1, n: the lists that each distinct set of a task goes to. `frequent` has shingles by ascending count. To
    measure, sets go to both kinds of lists (keys of the light kind have the highest bit set), but only to some of them."""
    order = np.argsort(frequent)
    ascending = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, f1s, ns, counts = [], [], [], []
            for n, f1, packed in zip(*(batch.column(c).to_pylist() for c in ("n", "f1", "hashes")), strict=True):
                if f1 in seen or rule.lonely(n):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(f1)
                s = np.frombuffer(packed, np.uint64)
                if len(ascending):
                    place = np.minimum(np.searchsorted(ascending, s), len(ascending) - 1)
                    often = ascending[place] == s
                    if often.any():
                        s = np.concatenate([s[~often], frequent[np.sort(order[place[often]])]])
                mine = []
                if n <= light or measure and (most_subsets is None or subsets(n, rule) <= most_subsets):
                    p = s[: rule.prefix(n, 2)]
                    i, j = np.triu_indices(len(p), 1)
                    mine.append(pairs_key(p[i], p[j]))
                if n * rule.den > light * rule.num or measure:
                    mine.append(s[: rule.prefix(n)] & _U((1 << 63) - 1))
                if measure:
                    mine = [k[(k >> _U(7)) % _U(MEASURED) == 0] for k in mine]
                keys += mine
                size = sum(map(len, mine))
                f1s.append(f1)
                ns.append(n)
                counts.append(size)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(f1s, np.int64), counts)), pa.array(np.repeat(np.array(ns, np.int64), counts))], ["key", "f1", "n"])

    return common.map_arrow(sets.select("n", "f1", "hashes"), run, "key long, f1 long, n long")


def pairs_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key, with its highest bit set, for two shingles in their order."""
    x = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0x632BE59BD9B4E019))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) | _U(1 << 63)


def entries_of(sizes: list[tuple[int, int]], light: int, rule: Rule) -> int:
    """How many entries list_entries() makes, from (size, sets) pairs."""
    return sum(k * (subsets(n, rule) * (n <= light) + rule.prefix(n) * (n * rule.den > light * rule.num)) for n, k in sizes)


def lists(entries: DataFrame, rule: Rule, n_entries: int) -> DataFrame:
    """list, members: the sets of each list in which two could link, equal lists once."""
    rows = entries.repartition(common.parts_of(entries.sparkSession, n_entries * ENTRY_BYTES, PARTITION_BYTES), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sizes = None, [], []
        found: list[np.ndarray] = []
        done: set[bytes] = set()

        def close() -> None:
            f1, at = np.unique(np.concatenate(nodes), return_index=True)
            n = np.concatenate(sizes)[at]
            by_size = np.argsort(n, kind="stable")
            n = n[by_size]
            # no set can link across a gap in sizes, so a list ends there
            for part in np.split(by_size, np.flatnonzero(n[:-1] * rule.den < n[1:] * rule.num) + 1):
                if len(part) < 2:
                    continue
                members = f1[np.sort(part)]
                digest = members.tobytes()
                if len(digest) <= 64:
                    if digest in done:
                        continue
                    if len(done) < 500_000:
                        done.add(digest)
                found.append(members)

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f1, n = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.diff(k)) + 1
            starts = np.concatenate([[0], edges])
            ends = np.concatenate([edges, [len(k)]])
            # lists within the batch that have one entry are done with at once
            keep = (ends - starts > 1) | (starts == 0) | (ends == len(k))
            for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
                if key is not None and k[a] != key:
                    if len(nodes) > 1 or len(nodes[0]) > 1:
                        close()
                    nodes, sizes = [], []
                key = k[a]
                nodes.append(f1[a:b].copy())
                sizes.append(n[a:b].copy())
            if len(found) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary())], ["members"])
                found = []
        if key is not None and (len(nodes) > 1 or len(nodes[0]) > 1):
            close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary())], ["members"])

    return common.map_arrow(rows, run, "members binary").withColumn("list", F.xxhash64("members")).dropDuplicates(["list", "members"])


def memberships(rows: DataFrame) -> DataFrame:
    """list, parts, f1 from lists()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members = [np.frombuffer(m, np.int64) for m in batch.column("members").to_pylist()]
            sizes = np.array([len(m) for m in members])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("list").to_numpy(), sizes)), pa.array(np.repeat(-(-sizes // PART), sizes)), pa.array(np.concatenate(members))], ["list", "parts", "f1"])

    return common.map_arrow(rows, run, "list long, parts long, f1 long")


def apart_at_least(sig: list[np.ndarray], rows: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each of `rows` and each set of a list a lower bound of the shingles they do not share. Counts of unequal
    length are compared at the shorter one's, to which the longer ones fold. Pairs whose sizes rule them out (limit
    below 0) are left at the largest number."""
    out = np.full((len(rows), len(sig)), 2**40, np.int64)
    level = np.array([len(x) for x in sig])
    for b in np.unique(level).tolist():
        which = np.flatnonzero((level == b) | (level == 2 * b))
        at = np.flatnonzero(np.isin(rows, which))
        if not len(at):
            continue
        same = np.stack([sig[k] if level[k] == b else sig[k][:b] + sig[k][b:] for k in which.tolist()])
        place = np.searchsorted(which, rows[at])
        step = max(1, (8 << 20) // (b * len(which)))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            apart = np.abs(same[place[k : k + step]][:, None, :] - same[None, :, :]).sum(2, dtype=np.int64)
            lower = np.minimum(level[rows[some]][:, None], level[which][None, :]) == b
            grid = np.ix_(some, which)
            out[grid] = np.where(lower & (limit[grid] >= 0), apart, out[grid])
    return out


def nearest(n: np.ndarray, sig: list[np.ndarray], comp: np.ndarray, f1: np.ndarray, mine: np.ndarray, most: int | None, rule: Rule, sparse: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b) with a < b: for each of the sets `mine` of a list its `most` nearest candidates outside its component; all
    of them if they are no more than `sparse`. And whether any were left out."""
    a, b, all_a, all_b, total = [], [], [], [], 0
    for at in range(0, len(mine), 256):
        rows = mine[at : at + 256]
        low, high = np.minimum(n[rows][:, None], n[None, :]), np.maximum(n[rows][:, None], n[None, :])
        limit = np.where((comp[rows][:, None] != comp[None, :]) & (low * rule.den >= high * rule.num), rule.most_apart(low + high), -1)
        if (limit < 0).all():
            continue
        apart = apart_at_least(sig, rows, limit)
        ok = apart <= limit
        if not ok.any():
            continue
        if most is None or total <= sparse:
            r, c = np.nonzero(ok)
            total += len(r)
            all_a.append(f1[rows[r]])
            all_b.append(f1[c])
        else:
            total += int(ok.sum())
        if most is not None:
            cost = np.where(ok, apart, 2**40)
            pick = np.argsort(cost, axis=1, kind="stable")[:, :most] if most > 1 else cost.argmin(1)[:, None]
            r = np.repeat(np.arange(len(rows)), pick.shape[1])
            c = pick.ravel()
            good = ok[r, c]
            a.append(f1[rows[r[good]]])
            b.append(f1[c[good]])
    dense = most is not None and total > sparse
    x, y = (a, b) if dense else (all_a, all_b)
    if not x:
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    x, y = np.concatenate(x), np.concatenate(y)
    return np.minimum(x, y), np.maximum(x, y), dense


def candidates(members: DataFrame, nodes: DataFrame, labels: DataFrame | None, most: int | None, rule: Rule) -> DataFrame:
    """a, b, dense: the pairs that a round verifies; and lists (in a, with dense set) of which pairs are left for the
    next round. Lists within one component are left out first."""
    if labels is None:
        rows = members.withColumn("comp", F.col("f1"))
    else:
        named = members.join(labels.select(F.col("node").alias("f1"), "label"), "f1", "left").withColumn("comp", F.coalesce("label", "f1")).drop("label")
        named = common.written(named, "named")
        open_ = named.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("list")
        rows = named.join(open_, "list", "left_semi")
    if most is None:  # a pair that several lists hold is taken in the first of them
        rows = rows.join(members.groupBy("f1").agg(F.collect_set("list").alias("lists")), "f1")
    else:
        rows = rows.withColumn("lists", F.array().cast("array<long>"))
    rows = rows.join(nodes, "f1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    rows = rows.select("list", "part", "parts", "f1", "n", "comp", "sig", "lists")
    rows = rows.repartition(common.parts_of(rows.sparkSession, members.count() * ROW_BYTES, COMPARED_BYTES), "list", "part").sortWithinPartitions("list", "part", "f1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out_a, out_b, left = [], [], set()

        def close() -> None:
            f1, n, comp, parts = (np.concatenate([h[i] for h in held]) for i in range(4))
            if len(f1) < 2:
                return
            sig = [np.frombuffer(x, np.uint8).astype(np.int16) for h in held for x in h[4]]
            mine = np.arange(len(f1))
            mine = mine[mine % parts[0] == key[1]]
            a, b, dense = nearest(n, sig, comp, f1, mine, most, rule, DENSE * len(mine))
            if most is None and len(a):
                of = {x: set(y) for h in held for x, y in zip(h[0].tolist(), h[5], strict=True)}
                first = np.array([min(of[x] & of[y]) == key[0] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                a, b = a[first], b[first]
            out_a.append(a)
            out_b.append(b)
            if dense:
                left.add(key[0])

        def flush() -> Iterator[pa.RecordBatch]:
            if not out_a:
                return
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
            a = np.concatenate([pairs[:, 0], np.array(sorted(left), np.int64)])
            b = np.concatenate([pairs[:, 1], np.zeros(len(left), np.int64)])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(pairs))], ["a", "b", "dense"])
            for x in (out_a, out_b, left):
                x.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c) for c in batch.schema.names}
            ls, part, parts, f1, n, comp = (col[c].to_numpy() for c in ("list", "part", "parts", "f1", "n", "comp"))
            sig, among = col["sig"].to_pylist(), col["lists"].to_pylist()
            edges = np.flatnonzero((np.diff(ls) != 0) | (np.diff(part) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(ls)], strict=True):
                now = (int(ls[i]), int(part[i]))
                if key is not None and now != key:
                    close()
                    held = []
                key = now
                held.append((f1[i:j].copy(), n[i:j].copy(), comp[i:j].copy(), parts[i:j].copy(), sig[i:j], among[i:j]))
            if sum(map(len, out_a)) > 200_000 or len(out_a) > 20_000:
                yield from flush()
        if key is not None:
            close()
        yield from flush()

    return common.map_arrow(rows, run, "a long, b long, dense boolean").distinct()


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: the pairs that link, by their sets. A filter of the pairs' nodes keeps other sets from moving. Sets are large
    and pairs may be many, so both joins are sort-merge joins at every size."""
    nodes = pairs.select(F.col("a").alias("f1")).unionAll(pairs.select(F.col("b").alias("f1")))
    held = one_each(sets.select("f1", "hashes"), node_filter(nodes))
    rows = pairs.hint("merge").join(held.select(F.col("f1").alias("a"), F.col("hashes").alias("x")), "a")
    rows = rows.hint("merge").join(held.select(F.col("f1").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = int(np.isin(x, y, assume_unique=True).sum()) if len(x) <= len(y) else int(np.isin(y, x, assume_unique=True).sum())
                good.append(rule.den * same >= rule.num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return common.map_arrow(rows.select("a", "b", "x", "y"), run, "a long, b long")


#: Bits of the filter of nodes: 16 a node, up to 16 MB.
FILTER_BITS = 1 << 27


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit table of nodes, by one hash each; more nodes than it is made for only let more sets through."""
    n = max(1, nodes.count())
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) % _U(bits)
            np.bitwise_or.at(table, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
        at = np.flatnonzero(table)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["at", "word"])

    merged = common.map_arrow(nodes.repartition(32, "f1"), run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[merged["at"].to_numpy()] = merged["word"].to_numpy().view(np.uint64)
    return table


def one_each(sets: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows of `sets` (f1 and more) that the filter lets through, one for each f1."""
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        seen: set[int] = set()
        for batch in batches:
            f1 = batch.column("f1").to_numpy()
            place = f1.view(np.uint64) % _U(64 * len(words))
            ok = (words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)
            for i in np.flatnonzero(ok).tolist():
                if (v := int(f1[i])) in seen:
                    ok[i] = False
                else:
                    seen.add(v)
            if ok.any():
                yield batch.filter(pa.array(ok))

    return common.map_arrow(sets, run, sets.schema).dropDuplicates(["f1"])


@dataclass(frozen=True)
class Joined:
    """What a join found: one row a document (did, th, n, f1), the classes of equal sets, and the components of classes."""

    documents: DataFrame
    labels: DataFrame
    links: DataFrame
    light: int


def told_apart(sets: DataFrame) -> DataFrame:
    """`sets` with an f1 for each (f1, f2): where several f2 share an f1, which few sets in a very large table do, these
    get hashes of both."""
    for _ in range(8):
        clash = sets.groupBy("f1").agg(F.min("f2").alias("x"), F.max("f2").alias("y")).where("x <> y").select("f1", F.lit(True).alias("__clash"))
        if clash.isEmpty():
            return sets
        renamed = sets.join(clash, "f1", "left").withColumn("f1", F.when(F.col("__clash"), F.xxhash64("f1", "f2")).otherwise(F.col("f1")))
        sets = common.written(renamed.select(*sets.columns), "told-apart")
    raise RuntimeError("sets can't be told apart")


def join(docs: DataFrame, rule: Rule, rounds: tuple[int | None, ...] = ROUNDS, most_subsets: int | None = MOST_SUBSETS) -> Joined:
    """The join of `docs` (doc_id, text; other columns are left out) with itself. With EVERY_LINK as rounds, `links` has
    every link between unlike sets once; else those that were needed to find the components. No link depends on `most_subsets`, the
    number of subsets that a light set has at most; with None the cost alone draws the boundary."""
    table = common.written(hashed_sets(docs, rule), "shingle-sets")
    sets = told_apart(table.where("kind = 0"))
    top = table.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f1").limit(FREQUENT).select("f1", "n").toArrow()
    frequent = top["f1"].to_numpy().view(np.uint64)[::-1].copy()
    sizes = [(r["n"], r["c"]) for r in sets.groupBy("n").agg(F.count_distinct("f1").alias("c")).collect() if not rule.lonely(r["n"])]
    lengths = list_entries(sets, frequent, 0, rule, measure=True, most_subsets=most_subsets).groupBy("key").agg(F.count_distinct("f1").alias("c"))
    scan = {r["light"]: SCAN_COST * r["pairs"] / r["entries"] for r in lengths.groupBy((F.col("key") < 0).alias("light")).agg(F.sum("c").alias("entries"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()}
    light = boundary(sizes, scan.get(True, 0.0), scan.get(False, 0.0), rule, most_subsets)
    members = common.written(memberships(common.written(lists(list_entries(sets, frequent, light, rule), rule, entries_of(sizes, light, rule)), "lists", NUMERIC_ROWS)), "members")
    nodes = common.written(one_each(sets.select("f1", "n", "sig"), node_filter(members.select("f1"))), "nodes")
    labels, links = None, None
    for most in rounds:
        found = common.written(candidates(members, nodes, labels, most, rule), "pairs", NUMERIC_ROWS)
        good = common.written(verified(found.where("NOT dense").select("a", "b"), sets, rule), "links")
        links = good if links is None else links.unionAll(good)
        labels = components(links)
        left = found.where("dense").select(F.col("a").alias("list"))
        if left.isEmpty():
            break
        members = common.written(members.join(left, "list", "left_semi"), "members")
    return Joined(sets.select("did", "th", "n", "f1"), labels, links, light)


def classes(joined: Joined) -> DataFrame:
    """did, th, n, f1, label, component: per document a name of its component and the smallest did in it. Documents
    without shingles have no component."""
    least = joined.documents.where("n > 0").groupBy("f1").agg(F.min("did").alias("least"))
    named = least.join(joined.labels, F.col("f1") == F.col("node"), "left").select("f1", "least", F.coalesce("label", "f1").alias("label"))
    named = common.written(named, "classes")
    whole = named.groupBy("label").agg(F.min("least").alias("component"))
    return joined.documents.join(named.join(whole, "label").select("f1", "label", "component"), "f1", "left")


def near_duplicates(docs: DataFrame, rule: Rule, most_subsets: int | None = MOST_SUBSETS) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are left out): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the own one included. Null and empty texts have no
    shingles and link with nothing, not even with each other. Repeated rows are in one component. A null doc_id is
    returned as such and is never the smallest beside others. An empty table gives no rows.
    """
    with common.workspace(docs.sparkSession, "jaccard") as keep:
        got = keep(classes(join(docs, rule, most_subsets=most_subsets)).select("did", "n", "component"), "near-duplicates")
    return got.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did")).alias("component_id"))


def link_counts(docs: DataFrame, rule: Rule) -> DataFrame:
    """near_duplicates() with a further column n_links: how many other rows of `docs` a row links with, copies included.

    Every candidate is verified, so the work grows with the number of links, which in a group of near copies is the
    square of its size. Rows without shingles have none.
    """
    with common.workspace(docs.sparkSession, "jaccard") as keep:
        joined = join(docs, rule, EVERY_LINK)
        copies = common.written(joined.documents.where("n > 0").groupBy("f1").agg(F.count(F.lit(1)).alias("copies")), "copies")
        ends = joined.links.unionAll(joined.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = ends.join(copies, F.col("b") == F.col("f1")).groupBy("a").agg(F.sum("copies").alias("others"))
        totals = copies.join(others, F.col("f1") == F.col("a"), "left").select("f1", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        got = keep(classes(joined).join(totals, "f1", "left").select("did", "n", "component", "n_links"), "link-counts")
    found = F.col("n") > 0
    return got.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(found, F.col("component")).otherwise(F.col("did")).alias("component_id"), F.when(found, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component: one row of each component, which
    has its smallest doc_id.

    Documents without shingles all stay. Among rows of a component that repeat its smallest doc_id, the text with the
    smallest hash stays, and of rows with equal texts one. A null doc_id stands for a component of such rows only.
    """
    with common.workspace(docs.sparkSession, "jaccard") as keep:
        got = common.written(classes(join(docs, rule)).where("n > 0").withColumn("first", F.col("did").eqNullSafe(F.col("component"))), "classes")
        best = got.where("first").groupBy("label").agg(F.min("th").alias("best"))
        stays = F.col("first") & (F.col("th") == F.col("best"))
        got = keep(got.join(best, "label").select(common.fold(F.col("did")).alias("did"), "th", stays.alias("stays")), "stays")
    did, th = common.fresh(docs, "did", "th")
    named = [F.col("did").alias(did), F.col("th").alias(th)]
    lose = got.where("NOT stays").select(*named).distinct()
    again = got.where("stays").groupBy("did", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*named)
    match = lambda rows: (common.fold(rows["doc_id"]) == F.col(did)) & (F.xxhash64(rows["text"]) == F.col(th))
    kept = docs.join(lose, match(docs), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, match(kept), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, match(kept), "left_anti").unionByName(once)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents, 3-word shingles, similarity 0.9."""
    return near_duplicates(common.load(spark, sf_dir, "documents"), Rule(3, 90, 100))


def op5_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_jaccard with the number of links of each document."""
    return link_counts(common.load(spark, sf_dir, "documents"), Rule(3, 90, 100))


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, list_slice(w, i, i + least(3, len(w)) - 1) AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""

#: The same with the number of documents that each one links with.
SQL_LINKS = SQL.replace("r.component_id\nFROM", "r.component_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links\nFROM")
