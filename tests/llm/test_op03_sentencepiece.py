import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from barlane.llm import common, op03_sentencepiece as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return op.Model(PATH)


def check(rows, want, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    brute = []
    for i, t in want:
        ids = library.encode(t or "")
        brute.append((str(i), len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else "")))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(brute)


def test_edge_documents(docs, doc_rows, library):
    check(op.encode_documents(docs, PATH).collect(), [(i, t) for i, t, _ in doc_rows], library)


def test_ids(docs, library):
    for r in op.encode_documents(docs.where("doc_id = 40"), PATH, with_ids=True).collect():
        assert r["ids"] == library.encode(docs.where("doc_id = 40").first()["text"])


def test_empty(empty):
    assert op.encode_documents(empty, PATH).count() == 0


def test_agenda_and_batches_equal_the_library(model, library):
    rng = random.Random(3)
    alphabet = "aeinorst the▁  \n\n.,é日本𝄞\x00́<s>'012xyz█"
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        want = library.encode(t)
        ids = np.frombuffer(model.encode([t])[0], "<u2")
        assert ids.tolist() == want
        assert not t or model.agenda("▁" + t.replace(" ", "▁")) == want
        assert model.decode(ids) == library.decode(want)


def test_decoding_of_any_ids(model, library):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 12))]
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_long_part(model, library):
    t = "ab" * 20_000
    assert np.frombuffer(model.encode([t])[0], "<u2").tolist() == library.encode(t)


def test_differences_are_found(model, monkeypatch):
    m = op.Model(PATH)
    monkeypatch.setattr(m, "agenda_many", lambda parts: [b"\x05\x00"] * len(parts))
    with pytest.raises(AssertionError):
        m.encode(["some words"])


def test_query(spark, sf_dir, library):
    rows = common.load(spark, sf_dir, "documents").collect()
    check(op.op3_sentencepiece(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in rows], library)


@pytest.mark.parametrize("odd", ["\nzebra", "  zebra", "zebra\n"])
def test_differences_in_any_part_of_any_text_are_found(odd):
    for k in range(8):
        m = op.Model(PATH)
        m.encode(["a"])
        part = next(p for p in m.split(f"text {k}{odd}") if "zebra" in p or p == "\n")
        m.cache[part] = b"\x05\x00"
        with pytest.raises(AssertionError, match="encodes"):
            m.encode([f"text {k}{odd}"])


def test_differences_in_decoding_of_any_text_are_found(monkeypatch):
    m = op.Model(PATH)
    monkeypatch.setattr(m, "decode", lambda ids: "other")
    for k in range(8):
        with pytest.raises(AssertionError, match="decodes"):
            list(op.digests(m, [f"text {k}"]))
