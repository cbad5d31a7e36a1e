"""Top-k search and chat formatting beside plain versions."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat, topk


def test_threshold_search_equals_all_products(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(160)]
    data += [(200 + i, [0.5] * 8) for i in range(20)] + [(50, [0.25] * 8), (250, [0.0] * 8), (300, None), (301, [None] * 8), (302, [math.nan] * 8), (303, [math.inf] * 8), (304, []), (None, [1.0] * 8), (305, [1.0] * 3)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<float>, x string, place int")
    got = [tuple(r) for r in topk.search_table(table).select("query_id", "rank", "vec_id", "score").collect()]
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in (f for f in fine if f[0] % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(y) == len(x))[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(got) == sorted(want)


def test_search_over_several_blocks_of_either_side(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(-4, 5, (700, 5))
    got = [tuple(r) for r in topk.search_table(spark.createDataFrame([(i, [float(c) / 256 for c in v]) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()]
    want = []
    for q in range(0, 700, 50):
        best = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_products_past_64_bits_are_refused(spark):
    table = lambda v: spark.createDataFrame([(0, [1.0, 1.0]), (1, v)], "vec_id long, embedding array<double>")
    assert topk.search_table(table([5e6, -5e6])).count() == 2 - 1
    with pytest.raises(Exception, match="64 bits"):
        topk.search_table(table([1e17, 1.0])).collect()


def test_search_stops_before_the_end():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (2000, 3))
    x[7] = 1000
    lists = topk.Lists(np.arange(2000), x)
    ids, scores, depth = lists.top(-1, np.array([1, 1, 1]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [3000] and depth < 50


def test_no_vectors(spark):
    assert topk.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


parts = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/", "s>", "[", "INST]", "é", "\n", " ", "n", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), parts), parts), max_size=5))
def test_template_reads_back(turns):
    turns = [(r, t) for r, t in turns]
    assert chat.parsed("".join("".join(chat.formatted(r, t)) for r, t in turns)) == turns
    for r, t in turns:
        assert not any(mark in chat.escaped(t) for mark in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert chat.unescaped(chat.escaped(t)) == t


CONVERSATIONS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <s> you"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello <s> you"), (2, 2, "user", "more"), (2, 3, "assistant", "done"),
                 (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "system", None), (4, 1, None, "x" * 5000), (5, None, "user", "late"), (5, 0, "assistant", ""), (5, 0, "assistant", ""),
                 (6, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "tool\nbox", "[/INST]")]


@pytest.fixture(scope="module")
def made(spark):
    from pagewright.session import stored
    table = spark.createDataFrame([(*c, "x") for c in CONVERSATIONS], "conv_id long, turn long, role string, text string, node string")
    walked = stored(chat.paths(table), "w")
    return walked, stored(chat.tree(walked), "t")


def test_conversations_read_back_from_the_tree(made):
    got = {r.conv_id: r for r in chat.read_back(*made).collect()}
    by = {}
    for c, n, role, text in sorted(CONVERSATIONS, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len("".join(chat.formatted(*t))) for t in turns)


def test_shared_turns_are_written_once_depth_first(made):
    nodes = made[1].collect()
    assert len(nodes) == len({r.node for r in nodes}) == 11
    for root in {r.tree for r in nodes}:
        own = sorted((r for r in nodes if r.tree == root), key=lambda r: r["at"])
        end = 0
        for r in own:
            assert r["at"] == end  # no gap, no overlap
            end += len(r.tokens)
            assert r.position == sum(x["to"] - x["from"] for x in r.attends)
            covered = [p for p in own if any(x["from"] <= p["at"] < x["to"] for x in r.attends)]
            assert [p.depth for p in covered] == list(range(1, r.depth))  # one ancestor of each depth, in order
            assert sum(len(p.tokens) for p in covered) == r.position and len(r.attends) <= 2


def test_no_conversations(spark):
    walked = chat.paths(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(walked, chat.tree(walked)).count() == 0
