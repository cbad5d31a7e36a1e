"""The prefix trie beside one built turn by turn."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pagewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, words string, n long"


def mark(role, text) -> str:
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, mark(role, text), role or "", text or ""))
    said = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(said.get(lead, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        more = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += more
            leaves[node[:d]] += node not in kids
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == node)
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node] if node in kids else 0, leaves[node], saved[node],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed: int, n: int, roles, texts, turns) -> list[tuple]:
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), rng.choice(texts), "p", "w", 1) for c in range(-30, n) for t in range(rng.choice(turns)) if rng.random() < 0.98]


@pytest.mark.parametrize(("seed", "block"), [(1, 4), (2, 4), (3, 1), (4, 3)])
def test_nodes_equal_a_trie_built_turn_by_turn(spark, monkeypatch, seed, block):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    rows = conversations(seed, 90, ["user", None, "a"], ["one two", None, "", "x", "very  long text \n here"], [0, 1, 2, 5, 9, 13])
    rows += [(7, None, "user", "first", None, None, None), (7, 2, "user", "tie", None, None, None), (7, 2, "b", "tie", None, None, None), (7, 2, "b", "tie", None, None, None),
             (None, 1, "user", "nobody's", None, None, None)]
    got = [tuple(r) for r in trie.led_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    rng = random.Random(9)
    long = [(1, t, "user", str(rng.randint(0, 5)) + " w" * (t % 3), None, None, None) for t in range(9000)]
    rows = long + [(2, t, r, x, None, None, None) for _, t, r, x, *_ in long[:8000]]
    rows += [(c, t, "user", "same as ever", None, None, None) for c in range(1000, 7000) for t in range(2)]
    got = {tuple(r) for r in trie.led_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_long(rows)
    assert {(r[0], r[1]): r for r in got} == {(r[0], r[1]): r for r in want} and len(got) == len(want)


def plain_long(rows: list[tuple]) -> set[tuple]:
    """``plain`` without a key as long as the way to each node."""
    said = defaultdict(list)
    for c, t, r, x, *_ in rows:
        said[c].append((r, x))
    children, members, way = [{}], [[]], {}
    up, last = [-1], [None]
    for c in sorted(said):
        h = zlib.crc32(str(c).encode()) % 4
        at = 0
        members[0].append(c)
        for turn in said.get(c - c % 20, [])[:h] + said[c][h:]:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                members.append([])
                up.append(at)
                last.append(turn[1])
            at = children[at][turn]
            members[at].append(c)
        way[c] = at
    ends = defaultdict(list)
    for c in sorted(way):
        ends[way[c]].append(str(c))
    n = len(children)
    saved, leaves, depth = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    for i in range(n - 1, -1, -1):
        saved[i] += (len(members[i]) - 1) * len(last[i].split()) if i else 0
        leaves[i] += not children[i]
        if i:
            saved[up[i]] += saved[i]
            leaves[up[i]] += leaves[i]
    return {(members[i][0], depth[i], members[up[i]][0] if i else None, len(members[i]), len(children[i]), leaves[i], saved[i],
             hashlib.sha256(",".join(ends[i]).encode()).hexdigest()) for i in range(n)}


def test_no_conversations_and_none_with_an_id(spark):
    assert trie.led_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.led_trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], SCHEMA)).count() == 0
