import random
import time
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from util import awkward, frame

from tidelake.llm import training_order as order

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 65537])
def test_permutation_is_a_bijection(n):
    slots = order.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 100 or slots.tolist() != order.permute(np.arange(n), n, key=1).tolist()


def test_permutation_of_a_wide_range_stays_inside_and_apart():
    n = 7 * order.EACH
    slots = order.permute(np.concatenate([np.arange(k * order.EACH, k * order.EACH + 3000) for k in range(7)]), n)
    assert len(set(slots.tolist())) == 21000 and int(slots.max()) < n
    assert all(2300 < c < 3700 for c in np.bincount((slots // np.uint64(order.EACH)).astype(int), minlength=7))


def test_shards_hold_every_sequence_once(spark, tmp_path):
    out, library = f"file://{tmp_path}/o", sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = frame(spark)
    rows = order.write_training_order(docs, PATH, out, length=16, shard=64).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    data, found = order.read_slots(out, 0, len(rows), length=16), defaultdict(list)
    for r in rows:
        found[r.doc_id].append(tuple(data[r.slot][: r.n_tokens].tolist()))
    want = defaultdict(list)
    for x in awkward():
        ids = [*library.encode(x[1] or ""), order.END]
        want[x[0]] += [tuple(ids[i : i + 16]) for i in range(0, len(ids), 16)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert (order.read_slots(out, 60, 10, length=16) == data[60:70]).all()
    again = order.write_training_order(docs, PATH, out, length=16, shard=64).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty_and_null_ids(spark, tmp_path):
    assert order.write_training_order(frame(spark, []), PATH, f"file://{tmp_path}/e").collect() == []
    rows = order.write_training_order(frame(spark, [(None, None, *[None] * 8)]), PATH, f"file://{tmp_path}/n").collect()
    assert [(r.slot, r.doc_id, r.n_tokens) for r in rows] == [(0, None, 1)]
    rows = order.write_training_order(frame(spark, [(i, "x", *[None] * 8) for i in (-5, -1, None, 7, 0)]), PATH, f"file://{tmp_path}/i").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, -5), (False, -1), (False, 0), (False, 7), (True, 0)]


def test_pieces_give_the_ids_of_whole_texts():
    library, r = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(3)
    signs = ["a", "b", " ", "  ", order.MARK, "é", "日本", "\t", "\n", "\u0301", "\uff43", "the", "<s>", "\0", "\U0001f600"]
    texts = ["".join(r.choices(signs, k=r.randrange(600))) for _ in range(300)] + [None, "", " ", "w" * 5000, "a " * 400, " " * 400, "a" + " " * 400 + "b", *(x[1] for x in awkward())]
    assert order._apart(library) and max(len(order._pieces(t or "")) for t in texts) > 100
    assert [x.tolist() for x in order._tokens(library, True, texts)] == [[*library.encode(t or ""), order.END] for t in texts]
    assert [x.tolist() for x in order._tokens(library, False, texts)] == [[*library.encode(t or ""), order.END] for t in texts]


def test_time_does_not_grow_with_the_words_seen_before():
    library, r = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(4)
    texts = [" ".join("".join(r.choices("abcdefgh", k=8)) for _ in range(40)) for _ in range(8000)]
    begun = time.process_time()
    for i in range(0, len(texts), 128):
        list(order._tokens(library, True, texts[i : i + 128]))
    pieces = time.process_time() - begun
    begun = time.process_time()
    for i in range(0, len(texts), 128):
        library.encode(texts[i : i + 128], num_threads=1)
    assert pieces < 2 * (time.process_time() - begun)
