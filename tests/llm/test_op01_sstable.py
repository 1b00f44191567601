import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barlane.llm import common, op01_sstable as op

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("shards", [1, 5])
def test_round_trip(spark, docs, doc_rows, tokenizer, shards):
    out = common.scratch(spark, "t1")
    manifest = op.write_shards(docs, out, PATH, 1, shards)
    got = op.read_shards(spark, manifest, out).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1]]
    key = lambda i: common.NO_ID if i is None else i
    assert [key(r["doc_id"]) for r in order] == sorted(key(i) for i, _, _ in doc_rows)
    want = sorted((key(i), len(x := [*ids_of(tokenizer, t), 1]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in doc_rows)
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    shards_of = op.directory(manifest)
    assert all(a[2] <= b[1] for a, b in zip(shards_of, shards_of[1:], strict=False))
    for i, t, _ in doc_rows:
        if i is not None and i != 30:
            assert op.lookup(out, shards_of, i).tolist() == [*ids_of(tokenizer, t), 1]
    assert op.lookup(out, shards_of, 31) is None


@pytest.mark.parametrize("same", [False, True])
def test_hot_doc_id_spreads(spark, make_docs, same):
    rows = [(7, "text" if same else f"text {i}") for i in range(200)] + [(8, "z")]
    out = common.scratch(spark, "t1")
    manifest = op.write_shards(make_docs(rows).repartition(8), out, PATH, 1, 4)
    assert manifest.count() > 2
    assert op.read_shards(spark, manifest, out).count() == 201


def test_empty_table(spark, empty):
    out = common.scratch(spark, "t1")
    assert op.read_shards(spark, op.write_shards(empty, out, PATH, 1), out).count() == 0


def test_lookup_reads_one_block():
    stream = io.BytesIO()
    w = op.Writer(stream, 2, 256)
    values = {i * 3 - 50: np.arange(i % 9, dtype="<u2") for i in range(500)}
    for k, v in values.items():
        w.add(k, v.tobytes())
    w.close()
    r = op.Reader(stream, len(stream.getvalue()))
    assert len(r.entries) > 20
    misses = 0
    for k in range(-60, 1500):
        r.blocks_read = 0
        got = r.get(k)
        assert (got is None) == (k not in values)
        if got is not None:
            assert got.tolist() == values[k].tolist() and r.blocks_read == 1
        else:
            misses += r.blocks_read
    assert misses < 60  # the Bloom filter spares most reads
    assert [k for k, _ in r.scan()] == list(values)


def test_format_is_checked():
    stream = io.BytesIO()
    w = op.Writer(stream, 2)
    w.add(2, b"\x01\x00")
    with pytest.raises(ValueError):
        w.add(1, b"")
    w.close()
    data = bytearray(stream.getvalue())
    data[-1] ^= 1
    with pytest.raises(ValueError):
        op.Reader(io.BytesIO(bytes(data)), len(data))
    data[-1] ^= 1
    data[op.Reader(io.BytesIO(bytes(data)), len(data)).index_at] ^= 1
    with pytest.raises(ValueError):
        op.Reader(io.BytesIO(bytes(data)), len(data))


def test_words_equal_whole_texts(tokenizer):
    e = op.Encoder(PATH)
    assert e.by_word
    texts = ["", " ", "a\x1cb c\u0085d", "İstanbul ΣΑΣ J̌ é <|endoftext|> it's 12ab", "x" * 3000, "ab,c. d!  e", "日本 語"]
    for _ in range(2):  # without and with the cache
        for t, got in zip(texts, e.texts(texts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == ids_of(tokenizer, t)


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = op.Encoder(path)
    assert not e.by_word
    t = Tokenizer.from_file(path)
    assert np.frombuffer(e.texts(["Hello  world\n ok"])[0], f"<u{e.width}").tolist() == t.encode("Hello  world\n ok", add_special_tokens=False).ids


def test_query(spark, sf_dir, tokenizer):
    got = {r["doc_id"]: r for r in op.op1_sstable(spark, sf_dir).collect()}
    start = 0
    for r in common.load(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = [*ids_of(tokenizer, r["text"]), 1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_marks_that_a_tokenizer_glues_to_words(tmp_path):
    """Words end with a suffix, and pieces are cut at white space only: a mark is part of its word there."""
    from tokenizers import models, pre_tokenizers

    letters = [*"abcdefghijklmnopqrstuvwxyz,.", *(f"{c}</w>" for c in "abcdefghijklmnopqrstuvwxyz,.")]
    made = [("h", "e"), ("l", "l"), ("he", "ll"), ("o", ",</w>"), ("hell", "o,</w>"), ("hell", "o</w>"), ("a", "b"), ("ab", "c</w>"), ("c", ".</w>"), ("ab", "c.</w>")]
    vocab = {t: i for i, t in enumerate([*letters, *("".join(m) for m in made)])}
    t = Tokenizer(models.BPE(vocab, made, end_of_word_suffix="</w>"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(path := str(tmp_path / "glued.json"))
    e = op.Encoder(path)
    assert e.by_word
    for text in ("hello, world. abc, again.", "hello abc. abc hello,", "x, y."):
        assert np.frombuffer(e.texts([text])[0], f"<u{e.width}").tolist() == ids_of(t, text)


def test_a_wrong_split_fails_the_job(monkeypatch):
    e = op.Encoder(PATH)
    monkeypatch.setattr(op, "CHECKED", 1)
    e.cache["hello"] = e.cache[""]
    with pytest.raises(AssertionError):
        e.texts(["hello world"])


def test_unfinished_files_are_swept(spark, make_docs):
    from pyarrow import fs

    out = common.scratch(spark, "t1")
    files, root = common.filesystem(out)
    files.create_dir(root)
    files.open_output_stream(f"{root}/.shard-0000000-lost").close()
    op.write_shards(make_docs([(1, "a b")]), out, PATH, 1, 1)
    assert [f.base_name for f in files.get_file_info(fs.FileSelector(root)) if not f.base_name.endswith(".crc")] == ["shard-0000000.sst"]
