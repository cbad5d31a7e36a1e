"""Licence scans beside plain searches."""
from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import licences

SCHEMA = "doc_id long, text string, lang string, n_words string, base long, label string"


def runs(tokens: list[int], templates: list[list[int]], least: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Every stretch of tokens that stands in a template and cannot go on to either side: ``(start, stop, its places)``, found by trying all."""
    def places(part):
        return [(t, e + len(part)) for t, s in enumerate(templates) for e in range(len(s) - len(part) + 1) if s[e:e + len(part)] == part]
    out = []
    for a in range(len(tokens)):
        b = a
        while b < len(tokens) and places(tokens[a:b + 1]):
            b += 1
        if b - a >= least and (not out or out[-1][1] < b):
            out.append((a, b, places(tokens[a:b])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(1, 4), max_size=30), st.integers(1, 3))
def test_matching_statistics_equal_a_plain_search(templates, tokens, least):
    automaton = licences.Automaton()
    for i, t in enumerate(templates):
        automaton.add(i, t)
    automaton.close()
    got = [(stop - n, stop, sorted(automaton.places[state])) for stop, n, state in automaton.matches(tokens, least)]
    assert got == runs(tokens, templates, least)


def plain_words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text: str | None):
    words, found = plain_words(text), []
    for phrase, label in licences.PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return len(words), sorted(found)


def texts() -> list[str | None]:
    rng = random.Random(7)
    notices = [t for _, t in licences.TEMPLATES]
    filler = ["the", "software", "and", "license", "Élan", "of", "cc", "by", "mit", "Apache", "terms", "zzz", "GNU", "general", "public", "under"]
    out: list[str | None] = [None, "", " \n", "CC-BY", "cc\x00by cc\x7fby ccéby", "MIT Licence", "MIT LICENSE mit license"]
    for _ in range(120):
        parts = [rng.choice(filler + ["\n", ", "]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(notices))
        out.append(rng.choice([" ", "-", "; "]).join(parts))
    return [*out, "word " * 50_000 + notices[7] + " word" * 50_000, "gnu general public license " * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "mine", 1, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, "the MIT license", None, None, None, None)], SCHEMA).repartition(3)


def test_base_places_equal_a_plain_search(docs):
    got = licences.labelled(docs).collect()
    given_ = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for doc_id, text in given_:
        n, found = plain_base(text)
        want.append((doc_id, n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("no", range(len(licences.TEMPLATES)))
def test_notices_are_found_changed_a_little_and_cut_ones_are_not(no):
    label, text = licences.TEMPLATES[no]
    scanner = licences.Scanner.of()
    before, after = "Some words here.\n", "\nand code(after) = 1"
    spans = [s for s in scanner.scan(before + text.upper() + after)[2] if s.template == no]
    assert [(s.start, s.stop - s.start, s.covered) for s in spans] == [(3, scanner.sizes[no], scanner.sizes[no])]
    words = text.split()
    if len(words) > 20:
        changed = [*words[:9], "extra", *words[9:14], "other", *words[15:]]
        found = [s for s in scanner.scan(before + " ".join(changed))[2] if s.template == no]
        assert len(found) == 1 and found[0].covered == scanner.sizes[no] - 1 and found[0].start == 3
        third = " ".join(words[: len(words) // 3])
        assert not [s for s in scanner.scan(third)[2] if s.template == no]
    assert label in {scanner.labels[s.template] for s in scanner.scan(text * 2)[2]}


def test_chains_are_the_best_of_all_orders():
    rng = random.Random(3)
    for _ in range(200):
        found, at = [], 0
        for _ in range(rng.randint(1, 7)):
            at += rng.randint(1, 9)
            found.append((at, rng.randint(0, 12), rng.randint(4, 6)))
            at += 6
        best = 0
        for mask in range(1, 1 << len(found)):
            some = [m for i, m in enumerate(found) if mask >> i & 1]
            if all(s + n <= t and a + n <= b and (t - s) - (b - a) <= 5 for (s, a, n), (t, b, _) in zip(some, some[1:])):
                best = max(best, sum(m[2] for m in some))
        spans = licences.chains(found, 0, 40, gap=5)
        assert max(s.covered for s in spans) >= min(best, 40)
        assert all(a.stop <= b.start for a, b in zip(spans, spans[1:]))


def test_own_templates_an_empty_table_and_a_text_of_one_notice_many_times(spark, docs):
    assert licences.labelled(docs.limit(0)).count() == 0
    own = licences.scan(docs.sparkSession.createDataFrame([(1, "x House rules apply to all of it y")], "doc_id int, text string"), [("house", "house rules apply to all of it")], {})
    row = own.first()
    assert (row.n_base, row.first_word, row.score) == (0, None, 1.0) and [(s.label, s.start, s.stop) for s in row.spans] == [("house", 1, 8)]
    many = licences.Scanner.of().scan((licences.TEMPLATES[7][1] + " . ") * 3000)
    assert len([s for s in many[2] if s.template == 7]) == 3000
