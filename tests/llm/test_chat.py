import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place long, key string"
DATA = "/root/testdata/sf0.01"


def rows():
    r = random.Random(2)
    texts = ["User: hi", "assistant: yes?", "ok", "", None, "long " * 60, "<|im_start|>system\nfoo<|im_end|>", "**Human:** x\nAI: y\nmore", "[AI] y", "word " * 20000, "a\r\nb\n\nc?"]
    out = [(c or None, i // 2 * 2 if i % 9 else None, r.choice(["user", "assistant", "system", "x", None]), r.choice(texts), 1, "clash") for c in range(6) for i in range(40)]
    return out + out[:3]


def model(r):
    n = chat.STATES + 1
    a = np.log(r.dirichlet(np.ones(n), n))
    a[:, -1] = chat.NEVER
    return a, np.concatenate([np.log(r.dirichlet(np.ones(7), n - 1)), np.full((1, 7), chat.NEVER)])


def worth(states, symbols, a, b, before):
    total = 0.0
    for s, x in zip(states, symbols, strict=True):
        total, before = total + a[before, s] + b[s, x], s
    return total


def test_matrices_and_paths_match_all_paths_tried():
    r = np.random.default_rng(1)
    a, b = model(r)
    sizes = np.array([1, 4, 2, 3, 4, 1])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols = r.integers(0, 7, sizes.sum())
    m = chat.block_matrices(symbols, starts, sizes, a, b)
    enter, leave = r.integers(0, chat.STATES + 1, len(sizes)), r.integers(0, chat.STATES, len(sizes))
    got = chat.decode_blocks(enter, leave, symbols, starts, sizes, a, b)
    for k, (x, size) in enumerate(zip(starts, sizes, strict=True)):
        own = symbols[x : x + size]
        best = {(i, j): max(worth((*p, j), own, a, b, i) for p in itertools.product(range(chat.STATES), repeat=size - 1)) for i in range(chat.STATES + 1) for j in range(chat.STATES)}
        assert all(abs(m[k, i, j] - w) < 1e-9 for (i, j), w in best.items())
        assert got[x + size - 1] == leave[k] and abs(worth(got[x : x + size], own, a, b, enter[k]) - best[enter[k], leave[k]]) < 1e-9


def test_chained_blocks_match_all_paths_tried():
    r = np.random.default_rng(2)
    a, b = model(r)
    for sizes in ([1, 2, 2], [5], [1, 1, 1, 1, 1], [3, 2]):
        symbols = r.integers(0, 7, 5)
        starts, sizes = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array(sizes)
        enter, leave = chat.chain(chat.block_matrices(symbols, starts, sizes, a, b), chat.STATES, None)
        got = chat.decode_blocks(np.array(enter), np.array(leave), symbols, starts, sizes, a, b)
        best = max(worth(p, symbols, a, b, chat.STATES) for p in itertools.product(range(chat.STATES), repeat=5))
        assert abs(worth(got, symbols, a, b, chat.STATES) - best) < 1e-9


@pytest.mark.parametrize(("block", "span"), [(512, 4096), (5, 3)])
def test_blocks_give_the_same_roles_as_whole_transcripts(spark, monkeypatch, block, span):
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "SPAN", span)
    lines = chat._lines(df)
    a, b = chat.fit(lines)
    got = chat.recover_lines(df).collect()
    assert len(got) == lines.count() == sum(len((x[3] or "").replace("\r\n", "\n").split("\n")) for x in rows())
    symbols = {(x.key, x.place): x.symbol for x in lines.collect()}
    state = {(x.key, x.place): chat.ROLES.index(x.role) + (0 if x.first else len(chat.ROLES)) for x in got}
    for key in {k for k, _ in symbols}:
        own = [symbols[key, p] for p in range(sum(k == key for k, _ in symbols))]
        one = np.array([len(own)])
        enter, leave = chat.chain(chat.block_matrices(np.array(own), np.array([0]), one, a, b), chat.STATES, None)
        best = chat.decode_blocks(np.array(enter), np.array(leave), np.array(own), np.array([0]), one, a, b)
        have = [state[key, p] for p in range(len(own))]
        assert abs(worth(best, own, a, b, chat.STATES) - worth(have, own, a, b, chat.STATES)) < 1e-6


def test_markers_split_messages_into_turns(spark):
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"some words {t}" * (1 + 4 * (t % 2)), 1, "k") for c in range(30) for t in range(6)]
    quoted = [(99, 0, None, "Human: what is it?\nAssistant: it is\na thing\nHuman: thanks", 1, "k")]
    got = sorted((x for x in chat.recover_roles(spark.createDataFrame(talk + quoted, SCHEMA)).collect() if x.conv_id == 99), key=lambda x: x.part)
    begin, middle, end = chat.RENDER
    assert [(x.role, x.n_lines, x.place) for x in got] == [("user", 1, 0), ("assistant", 2, 1), ("user", 1, 3)]
    assert got[1].rendered == f"{begin}assistant{middle}it is\na thing{end}" and got[0].rendered == f"{begin}user{middle}what is it?{end}"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_roles_of_unlabelled_conversations(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    hidden = df.withColumn("role", F.when(F.col("conv_id") % 2 == 0, F.col("role")))
    truth = {(x.conv_id, x.turn): x.role for x in df.collect()}
    got = [x for x in chat.recover_lines(hidden).collect() if x.conv_id % 2]
    assert all(x.label is None for x in got)
    assert sum(truth[x.conv_id, x.turn] == x.role for x in got) / len(got) > 0.9


def test_rows_without_ids_and_empty(spark):
    df = spark.createDataFrame([(None, None, "user", None, 1, "k")] * 3 + [(1, 2, "user", "x\ny", 1, "k"), (1, 2, "user", "x\ny", 1, "k")], SCHEMA)
    got = chat.recover_roles(df).collect()
    assert sorted((x.conv_id or 0, x.place, x.n_lines) for x in got) == [(0, 0, 1)] * 3 + [(1, 0, 2), (1, 2, 2)]
    assert chat.recover_roles(spark.createDataFrame([], SCHEMA)).collect() == []
