"""Phrase collocation mining by pivot partitioning, as in MG-FSM.

1. Words are counted by language. Those below the least frequency can be in no frequent phrase.
2. The pivot of a phrase is its rarest word, at its first place if it has several. A pivot's partition gets, of every piece, the words around each of its
   occurrences, up to LONGEST - 1 on a side, cut off at the first word that is rarer (on the left: or the pivot itself), so
   that each occurrence of a phrase is in just one fragment of its pivot. Equal fragments are counted together before they move.
3. A partition counts the phrases of its fragments that hold the pivot. All of a phrase's occurrences are there, so it keeps the frequent ones only.
   A pivot too frequent for one task is dealt to several, which pass all their counts on to be added up.
4. Phrases are cut into two parts, which are frequent themselves and so in the same table.

Tasks learn how frequent words are from a table of SLOTS numbers by the words' hash (16 MB, whatever the vocabulary): the largest
frequency of the slot's frequent words, 0 if there are none. Where words share a slot, a rare word may pass for a frequent one, or the pivot is another
word of the phrase, the same for all its occurrences: results do not change. Words are named by 64-bit hashes; should two words share one of
these, another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlane.llm import common

LEAST = 100
LONGEST = 5
TOP = 2000
SLOTS = 1 << 22
#: Occurrences of a pivot that one task gets at most, about.
PIVOT_ROWS = 1 << 18
#: Words of the input for each partition of pivots.
PART_WORDS = 1 << 17
#: Fragments that a task mines together, about.
MINE_ROWS = 1 << 16
TOP_ROWS = 1 << 18
GROUP_CHARS = 2 << 20
_U = np.uint64
_SEP = 0xFF  # never in UTF-8
_SPACE = 0x20
_TABLE = bytes(_SEP if c in b".,;:!?\n\x0b\x0c\r" else _SPACE if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Tokens:
    """The words of some texts in lower case, with a mark between pieces and before each text."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer((b"\n" + b"\n".join(raw) + b"\n").translate(_TABLE), np.uint8)
        mark, word = data == _SEP, data != _SPACE
        first = word & (mark | np.append(True, ~word[:-1] | mark[:-1]))
        kept = np.flatnonzero(word)
        offsets = np.append(np.flatnonzero(first[kept]), len(kept)).astype(np.int32)
        chars = np.ascontiguousarray(data[kept])
        tokens = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
        coded = tokens.dictionary_encode()
        #: Distinct words, one of them the mark; which of them each token is; whether it is a word.
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.is_word = ~mark[kept[offsets[:-1]]]
        texts_at = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        #: Which text each token is of.
        self.text = np.searchsorted(texts_at, kept[offsets[:-1]], "right") - 1

    def hashes(self, seed: int) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), _U, len(self.words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lang_hashes(langs: list[str], seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(b"\xff" + x.encode(), seed) for x in langs], _U)


def keyed(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of words in languages; never 0."""
    h = mix(langs + mix(words))
    return np.where(h == 0, _U(1), h)


def counted(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, n: all words of all languages with the hash that names them."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in common.grouped(batches, GROUP_CHARS):
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            t = Tokens(texts)
            d = len(t.words)
            both = np.array([place[x] for x in langs], np.int64)[t.text] * d + t.codes
            which, n = np.unique(both[t.is_word], return_counts=True)
            h = keyed(lang_hashes(names, seed)[which // d], t.hashes(seed)[which % d])
            words = pa.array(t.words, pa.binary()).take(pa.array(which % d)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(which // d)), words, pa.array(h.view(np.int64)), pa.array(n)], ["lang", "word", "h", "n"])

    got = common.map_arrow(rows, run, "lang string, word string, h long, n long")
    return got.groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("n").alias("n"))


def slots(words: DataFrame) -> np.ndarray:
    """The largest frequency of each slot's words, from words (h, n). SLOTS rows at most reach the driver."""
    found = words.groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint32)
    out[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    return out


def same_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal ones stand together, and where each group of them begins."""
    h = np.zeros(len(rows), _U)
    for column in rows.T:
        h = mix(h * _U(0x9E3779B97F4A7C15) + column)
    order = np.argsort(h)
    new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(1))
    if (new[1:] & (h[order[1:]] == h[order[:-1]])).any():  # two rows share a hash
        order = np.lexsort(rows.T)
        new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(1))
    return order, np.flatnonzero(new)


def fragments(docs: DataFrame, table: Broadcast, longest: int, seed: int, parts: int) -> DataFrame:
    """part, n, shape, words: the fragments of all pivots, those of one partition in a text batch as one row of binaries. Per
    fragment n is how often it is there (8 bytes), shape how many words it has before and after the pivot and whether the pivot is dealt to
    several partitions (3 bytes), and words the hashes of all its words (8 bytes each)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = table.value
        for langs, texts in common.grouped(batches, GROUP_CHARS):
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            t = Tokens(texts)
            h = keyed(lang_hashes(names, seed)[np.array([place[x] for x in langs], np.int64)[t.text]], t.hashes(seed)[t.codes])
            f = np.where(t.is_word, frequency[(h & _U(SLOTS - 1)).astype(np.int64)], 0)
            h = np.pad(np.where(f > 0, h, _U(0)), reach)
            # The order of words: by frequency, then by hash; 0 for what ends a fragment.
            key = np.pad((f.astype(_U) << _U(32)), reach) | (h & _U(2**32 - 1))
            size, own = len(f), key[reach : reach + len(f)]
            left = right = np.zeros(size, np.int8)
            go_left = go_right = own > 0
            for d in range(1, reach + 1):
                go_left = go_left & (key[reach - d : reach - d + size] > own)
                go_right = go_right & (key[reach + d : reach + d + size] >= own)
                left, right = left + go_left, right + go_right
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            left, right = left[at], right[at]
            offset = np.arange(-reach, reach + 1, dtype=np.int8)
            matrix = np.where((offset >= -left[:, None]) & (offset <= right[:, None]), h[at[:, None] + reach + offset], _U(0))
            order, begin = same_rows(matrix)
            n = np.diff(np.append(begin, len(order)))
            pick = order[begin]
            pivot, salts = matrix[pick, reach], f[at[pick]] // PIVOT_ROWS + 1
            salt = mix(matrix[pick].sum(1)) % salts.astype(_U)
            part = (mix(pivot + salt * _U(0x9E3779B97F4A7C15)) % _U(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            part, pick, n, many = part[by], pick[by], n[by], salts[by] > 1
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            shape = np.stack([left[pick], right[pick], many.astype(np.int8)], 1)
            matrix = matrix[pick]
            ends = np.append(cut, len(part))
            words = np.append(0, (shape[:, 0].astype(np.int64) + shape[:, 1] + 1).cumsum())
            binary = lambda data, at: pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), binary(n, ends * 8), binary(shape, ends * 3), binary(matrix[matrix != 0], words[ends] * 8)], ["part", "n", "shape", "words"])

    return common.map_arrow(rows, run, "part int, n binary, shape binary, words binary")


def count(matrix: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, many: np.ndarray, least: int) -> pa.RecordBatch:
    """phrase, a: how often each phrase that holds the pivot is in fragments, which are rows with the pivot in the middle. Less than `least` occurrences go
    on only where the pivot's others are counted elsewhere."""
    reach = matrix.shape[1] // 2
    phrases, counts, whole = [], [], []
    for a in range(reach + 1):
        for b in range(max(0, 1 - a), reach + 1 - a):
            at = np.flatnonzero((left >= a) & (right >= b))
            part = np.zeros((len(at), reach + 1), _U)
            part[:, : a + b + 1] = matrix[at, reach - a : reach + b + 1]
            phrases.append(part)
            counts.append(n[at])
            whole.append(many[at])
    rows, n, many = np.concatenate(phrases), np.concatenate(counts), np.concatenate(whole)
    order, begin = same_rows(rows)
    total, pick = np.add.reduceat(n[order], begin), order[begin]
    keep = (total >= least) | many[pick]
    rows, total = rows[pick[keep]], total[keep]
    inside = rows != 0
    ends = np.append(0, inside.sum(1).cumsum()).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[inside].view(np.int64))), pa.array(total)], ["phrase", "a"])


def mined(found: DataFrame, least: int, longest: int, parts: int) -> DataFrame:
    """phrase (hashes of its words) and a, its frequency, of all phrases of 2 to `longest` words with `least` occurrences. A task holds the fragments
    of one part, and the phrases of whole pivots of about MINE_ROWS of them."""
    reach = longest - 1
    dealt = found.repartition(max(parts, found.sparkSession.sparkContext.defaultParallelism), "part").sortWithinPartitions("part")

    def mine(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
        n, shape, words = join("n", np.int64), join("shape", np.int8).reshape(-1, 3), join("words", _U)
        left, right = shape[:, 0].astype(np.int64), shape[:, 1].astype(np.int64)
        size = left + right + 1
        first = size.cumsum() - size
        pivot = words[first + left]
        order = np.argsort(pivot, kind="stable")
        pivot = pivot[order]
        new = np.append(True, pivot[1:] != pivot[:-1])
        group = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) // MINE_ROWS
        for rows_of in np.split(order, np.flatnonzero(group[1:] != group[:-1]) + 1):
            width = size[rows_of]
            row = np.repeat(np.arange(len(rows_of)), width)
            step = np.arange(len(row)) - np.repeat(width.cumsum() - width, width)
            matrix = np.zeros((len(rows_of), 2 * reach + 1), _U)
            matrix[row, step + (reach - left[rows_of])[row]] = words[first[rows_of][row] + step]
            yield count(matrix, left[rows_of], right[rows_of], n[rows_of], shape[rows_of, 2] > 0, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["part"] != r["part"]:
                    yield from mine(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from mine(rows)

    got = common.map_arrow(dealt, run, "phrase array<long>, a long")
    return got.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one of the same frequency holds, from phrases (phrase, a), frequent words (lang, word, h,
    n) and totals (lang, n). The score is that of the lowest cut, in exact decimals."""
    size = F.size("phrase")
    ends = F.array(F.slice("phrase", 1, size - 1), F.slice("phrase", 2, size - 1))
    held = phrases.where(size > 2).select(F.explode(ends).alias("phrase"), "a").distinct()
    left = phrases.join(held, ["phrase", "a"], "left_anti")
    spelled = left.select("phrase", "a", F.posexplode("phrase").alias("at", "h")).join(words.select("h", "lang", "word"), "h")
    spelled = spelled.groupBy("phrase", "a").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    every = phrases.unionByName(words.select(F.array("h").alias("phrase"), F.col("n").alias("a")))
    cuts = spelled.join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("first", F.expr("slice(phrase, 1, k)")).withColumn("rest", F.expr("slice(phrase, k + 1, size(phrase) - k)"))
    cuts = cuts.join(every.select(F.col("phrase").alias("first"), F.col("a").alias("l")), "first").join(every.select(F.col("phrase").alias("rest"), F.col("a").alias("r")), "rest")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000 * ({exact('a')} * {exact('n')})) div ({exact('l')} * {exact('r')})").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", F.col("text").alias("phrase"), "a", "n").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language, numbered; chosen part by part first, so that no task orders a language's phrases."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = 1 + found.count() // TOP_ROWS
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top).drop("place")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, seed: int = 0) -> DataFrame:
    """Per language of `docs` (lang, text; other columns are left out) its `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Pieces are what lies between `.,;:!?` and line breaks, words what lies between spaces and tabs in them; A-Z are lower-cased.
    A null lang is und, a null text is empty. Repeated rows count each. Ties are ordered by frequency and phrase. Empty
    tables and languages without a frequent phrase give no rows.
    """
    spark = docs.sparkSession
    with common.workspace(spark, "collocations") as keep:
        words = common.written(counted(docs, seed), "words")
        frequent = common.written(words.where(F.col("n") >= least), "frequent")
        shared = words.groupBy("h").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if clear := shared.isEmpty():
            totals = common.written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            parts = min((totals.agg(F.sum("n")).first()[0] or 0) // PART_WORDS + 1, 1 << 20)
            table = spark.sparkContext.broadcast(slots(frequent))
            phrases = common.written(mined(fragments(docs, table, longest, seed, parts), least, longest, parts), "phrases")
            table.destroy()
            got = keep(ranked(common.written(scored(phrases, frequent, totals), "scored"), top), "collocations")
    if not clear:
        return collocations(docs, least, longest, top, seed + 1)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return collocations(common.load(spark, sf_dir, "documents"))


SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs
), grams AS (
    SELECT lang, k, list_slice(w, i, i + k - 1) AS g
    FROM (SELECT lang, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS k))
), f AS (
    SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM f WHERE k > 1 AND a >= {LEAST}
), held AS (
    SELECT DISTINCT lang, list_slice(g, i, i + m - 1) AS g, a FROM (
        SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
), parts AS (
    SELECT c.lang, c.g, c.a, c.cut, n, x.a AS l, y.a AS r, CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates ANTI JOIN held USING (lang, g, a)) c
    JOIN totals USING (lang)
    JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.cut)
    JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.cut + 1, len(c.g))
), lowest AS (
    SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {TOP}
"""
