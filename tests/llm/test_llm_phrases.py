"""Phrase mining beside counting everything."""
from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import phrases

SCHEMA = "doc_id long, text string, lang string, level int, f long, word string"
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS))]


def counted(rows) -> Counter:
    out = Counter()
    for _, text, lang, *_ in rows:
        for ws in pieces(text):
            out.update((lang or "und", tuple(ws[i:i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    return out


def plain(rows, least: int, most: int) -> list[tuple]:
    f, out = counted(rows), []
    for lang in sorted({k[0] for k in f}):
        n = sum(v for (la, p), v in f.items() if la == lang and len(p) == 1)
        candidates = {p: v for (la, p), v in f.items() if la == lang and len(p) > 1 and v >= least}
        held = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                held.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(held)[:most], 1)]
    return out


def sample(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Of", "the", "in", "é", "x y", "new", "york", "City", "a\x00b", "and", "on", "or", "but", "it", "is"]
    out = []
    for i in range(150):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(["New York City", "in the new york", "is it or"]) for _ in range(rng.randint(0, 40))]
        out.append((i, "".join(p + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for p in parts), rng.choice(["en", "fr", None, "und"]), 1, 2, "w"))
    return [*out, out[3], out[3], (None, None, "en", None, None, None), (7, "", "xx", None, None, None), (8, "only words of one", "yy", None, None, None),
            (9, "again and again " * 20_000, "en", None, None, None)]


@pytest.mark.parametrize(("seed", "least", "sample_of", "most"), [(1, 6, 2, 2000), (2, 5, 1_000_000, 9), (3, 9, 6, 2000)])
def test_lists_equal_counting_everything(spark, monkeypatch, seed, least, sample_of, most):
    """A sample of nothing proposes nothing, so every frequent phrase is missed at first; small batches meet in Spark."""
    monkeypatch.setattr(phrases, "HELD_COUNTS", 500)
    monkeypatch.setattr(phrases, "AT_ONCE", 300)
    rows = sample(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.listed(docs, least, sample_of, most).collect()]
    assert sorted(got) == sorted(plain(rows, least, most))


def test_misses_lead_to_further_passes_and_counts_are_exact(spark):
    rows = sample(4)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(lang, " ".join(p)): n for (lang, p), n in counted(rows).items() if n >= 7}
    for sample_of, passes in ((1, 1), (1_000_000, 3)):
        found, sizes, took = phrases.frequent(docs, 7, sample_of)
        assert {(r.lang, r.phrase): r.f for r in found.collect()} == want and took == passes
        assert {r.lang: r.n for r in sizes.collect()} == {lang: sum(n for (la, p), n in counted(rows).items() if la == lang and len(p) == 1)
                                                         for lang in {r[2] or "und" for r in rows}}


def test_numbers_past_64_bits(spark):
    big = 1 << 62
    given = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2), ("en", "a b a", 3, (big - 2) // 5 * 4), ("en", "b a", 2, 40)]
    df = spark.createDataFrame(given, "lang string, phrase string, level int, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(df).collect()}
    assert got["a b"] == (big - 2, big, big - 1, 2_000_000 * (big - 2) // (2 * big - 1))
    assert got["b a"] == (40, big - 1, big, 2_000_000 * 40 // (2 * big - 1))
    assert {r.phrase: r._most for r in phrases.inside(df).collect()} == {"a b": (big - 2) // 5 * 4, "b a": (big - 2) // 5 * 4}


def test_known_phrases_are_told_from_others_of_their_key(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILE_BITS", 2)
    given = [("en", f"w{i} v{i % 7}", 2, 1) for i in range(200)]
    phrases.ship_package(spark)
    known = phrases.known_phrases(phrases.hashed(spark.createDataFrame(given, "lang string, phrase string, level int, f long")).selectExpr("*", "key % 2 = 0 as new"))
    assert known.bits > 3 and len(known.files) > 4
    keyed = [phrases.phrase_key("en", p.encode().split()) for _, p, *_ in given]
    keys = np.array([k for k, _, _ in keyed], np.uint64)
    checks = np.array([c for _, c, _ in keyed], np.uint64)
    found, new = known.find(2, keys, lambda at: checks[at])
    assert found.all() and (new == (keys.view(np.int64) % 2 == 0)).all()
    assert not known.find(2, keys, lambda at: checks[at] + np.uint64(1))[0].any() and not known.find(3, keys, lambda at: checks[at])[0].any()


def test_an_empty_table(spark):
    assert phrases.listed(spark.createDataFrame([], SCHEMA)).count() == 0
