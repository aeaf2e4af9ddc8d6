import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from util import awkward, frame

from tidelake.llm import base
from tidelake.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_match_the_library(library):
    e, r = bpe.Encoder(bpe.read_model(PATH)), random.Random(5)
    parts = ["a", "b", "e", "th", "▁", " ", "  ", "\n", "é", "日", "𝔘", "<0x41>", "<s>", "&&&", "...", ",", "the", "\t", "'s", "\x00", "é", "ing"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(0, 14)))
        ids = library.encode(t)
        assert e.encode(t) == ids and e.decode(ids) == library.decode(ids)
        assert e.digest(t) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_long_run_and_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    e, r = bpe.Encoder(bpe.read_model(PATH)), random.Random(6)
    t = "".join(r.choices("abcdeth", k=5000)) + " " + " ".join("".join(r.choices("abcdeth", k=5)) for _ in range(500))
    assert e.encode(t) == library.encode(t)


def test_tables(spark, library):
    docs = frame(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digests(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for x in awkward():
        ids = library.encode(x[1] or "")
        want.add((x[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
    encoded = bpe.encode_documents(docs, PATH)
    texts = sorted((r.doc_id, r.text) for r in bpe.decode_documents(encoded, PATH).collect())
    assert texts == sorted((x[0], library.decode(library.encode(x[1] or ""))) for x in awkward())
    assert bpe.encode_documents(frame(spark, []), PATH).collect() == []


def test_freed_memory_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append(1))
    bpe.encoder(bpe.read_model(PATH)).forget()
    assert len(calls) == 2
    base.give_back()


def test_nothing_of_the_texts_is_kept_after_a_task(library):
    own = bpe.Encoder(bpe.read_model(PATH))
    for text in ("some common words", "naïve 日本 x1"):
        own.digest(text)
    own.forget()
    assert not any(len(x) or len(x.old) for x in (own.word, own.segment, own.compatible))
    assert own.encode("some common words") == library.encode("some common words")
