"""Operators over documents beside plain versions, on rows with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import exact, lm, mixing, packing, pii, simhash, suffix, toxicity
from pagewright.llm.common import components
from pagewright.session import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, bucket long"
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def low(text: str | None) -> bytes:
    return (text or "").encode().translate(LOW)


def sample() -> list[tuple]:
    rng = np.random.default_rng(5)
    words = ["amber", "bolt", "Cedar", "delta", "ÉCLAT", "fjord", "grün", "hollow", "iris", "jade"]
    line = lambda n: " ".join(rng.choice(words, n))
    texts = [line(int(n)) for n in rng.integers(1, 90, 40)]
    texts += [texts[3], texts[3].upper(), texts[4] + " tail", None, "", " \t\n", "x" * 70_000 + line(5), "y" * 300, "ab" * 400, texts[5] + "\n" + texts[6]]
    data = [(i, t, "en", ["a", "b", None, "é"][i % 4], len(t or ""), "mine", 7) for i, t in enumerate(texts)]
    return [*data, data[7], data[7], (None, texts[8], None, None, None, None, None), (None, "only here once or so", None, "a", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(sample(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ---


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.data())
def test_hashes_compose_in_any_grouping(data, draw):
    whole = exact.chunk_hash(data)
    cut = draw.draw(st.integers(0, len(data)))
    assert exact.combined(exact.chunk_hash(data[:cut]), exact.chunk_hash(data[cut:])) == whole
    direct = [0, 0]
    for b in data:
        direct = [(d * base + b + 1) % p for d, base, p in zip(direct, exact.BASES, exact.PRIMES, strict=True)]
    assert whole == (len(data), *direct)


def test_long_texts_hash_by_chunks():
    data = bytes(range(256)) * 700
    assert exact.fingerprint(data) == exact.combined(exact.fingerprint(data[:100_000]), exact.fingerprint(data[100_000:]))


@pytest.mark.parametrize("hash_chunk", [exact.chunk_hash, lambda chunk: (len(chunk), len(chunk) % 3, 0)])
def test_exact_classes_equal_a_plain_grouping(docs, hash_chunk):
    """The second hash makes every text of a length collide, so classes rest on the comparison."""
    groups = defaultdict(list)
    for r in sample():
        groups[low(r[1])].append(r[0])
    got = exact.exact_classes(docs, hash_chunk).collect()
    assert len(got) == len(sample())
    kept = Counter()
    for r in got:
        members = next(ids for text, ids in groups.items() if hashlib.sha256(text).hexdigest() == r.text_sha256)
        assert r.group_size == len(members)
        assert r.keep_id == max((i for i in members if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_groups_of_many_copies_are_compared_beside_several_of_the_first(spark, monkeypatch):
    """Of some 2,000 rows of one fingerprint two texts are meant; each is a class of its own."""
    monkeypatch.setattr(exact, "GROUP_ROWS", 50)
    rows = [(i, "SAME text" if i % 3 else "some TEXT", "en", "a", 1, "mine", 7) for i in range(2000)] + [(5000, "long " * 40_000, "en", "a", 1, "mine", 7)] * 120
    got = exact.exact_classes(spark.createDataFrame(rows, SCHEMA).repartition(5), lambda chunk: (len(chunk), 1, 2)).collect()
    sizes = Counter((low(r[1])) for r in rows)
    assert Counter(r.group_size for r in got) == Counter(sizes[low(r[1])] for r in rows) and sum(r.kept for r in got) == 3
    assert {(r.keep_id, r.group_size) for r in got} == {(1999, 1333), (1998, 667), (5000, 120)}


def test_copies_of_a_first_text_are_not_sent_to_the_driver(spark, sent, monkeypatch):
    """A group of many copies has its first text beside each so many of them, and Spark sizes these as one."""
    monkeypatch.setattr(exact, "GROUP_ROWS", 4)
    plans = []
    monkeypatch.setattr(exact, "stored", lambda df, name, **options: (plans.append(sent(df)), stored(df, name, **options))[1])
    kept = exact.exact_dedup(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text")))
    assert [r.doc_id for r in kept.collect()] == [39]
    assert plans and not [part for parts in plans for part in parts if "Generate" in part]


def test_exact_dedup_keeps_one_row_of_each_text_and_its_columns(docs):
    out = exact.exact_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(r[1]) for r in sample()})
    assert {r._row for r in rows} <= {"mine", None}


# --- SimHash ---


def plain_fingerprint(text: str | None) -> int:
    words = low(text).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    value = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) * 2 > len(grams):
            value |= 1 << bit
    return value


def test_fingerprints_equal_a_plain_count(docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert got == sorted((r[0] is not None, r[0] or 0, plain_fingerprint(r[1])) for r in sample())


def linked(values: list[int]) -> dict[int, int]:
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                low_, high = sorted((find(a), find(b)))
                root[high] = low_
    return {v: find(v) for v in values}


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 3])
def test_links_connect_what_differs_in_two_bits(spark, cell_rows):
    rng = np.random.default_rng(2)
    values = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)}
    for v in list(values)[:20]:
        for _ in range(4):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                v ^= (1 << bit) - (1 << 64 if bit == 63 else 0)
            values.add(v)
    values |= {0, 1, 3, 7, -1}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), cell_rows)
    got = {r.node: r.root for r in components(links).collect()}
    unsigned = [v % (1 << 64) for v in values]
    roots = linked(unsigned)
    groups, want = defaultdict(set), defaultdict(set)
    for v in values:
        groups[got.get(v, v)].add(v)
        want[roots[v % (1 << 64)]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_cells_and_words_of_fingerprints_are_not_sent_to_the_driver(spark, sent):
    """They are 33 and 65 a fingerprint, yet Spark sizes them as the fingerprints they are exploded from."""
    nodes = stored(spark.range(-400, 400).select((F.col("id") * 3).alias("fp")), "nodes")
    links = simhash.links(nodes, 3)
    assert not [part for part in sent(links) if "Generate" in part]
    assert links.count()


def test_near_classes_and_dedup(docs):
    rows = sample()
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = linked(sorted(set(prints)))
    least = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        least[roots[p]].append(r[0])
    want = Counter((r[0], min((i for i in least[roots[p]] if i is not None), default=None)) for r, p in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_classes(docs).collect()) == want
    assert simhash.near_dedup(docs).count() == len(least)


# --- mixing ---


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), share * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_mix_meets_its_targets_and_repeats(docs):
    rows = sample()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = plain_targets(sizes)
    got = mixing.taken(docs, block_rows=4, shard_words=50)
    named = got.join(docs.select("doc_id", "source").dropna(subset="doc_id").distinct(), "doc_id").collect()
    for r in named:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken in (0, r["size"], 2 * r["size"])
    again = mixing.taken(docs, block_rows=4, shard_words=50)
    assert sorted(map(tuple, got.fillna(-1).collect())) == sorted(map(tuple, again.fillna(-1).collect()))
    placed, mix = mixing.plan(docs, block_rows=4, shard_words=50)
    words = {r.idx: r.w for r in mix.join(placed.select("_row", "size"), "_row").groupBy("idx").agg(F.sum("size").alias("w")).collect()}
    targets = {r.idx: r.target for r in placed.select("idx", "target").distinct().collect()}
    assert all(targets[i] - 30 <= words[i] <= targets[i] + 1e-6 for i in targets)
    drawn = mix.collect()
    assert len({(r._row, r.turn) for r in drawn}) == len(drawn)  # shards' blocks are disjoint
    assert max(r.shard for r in drawn) > 3
    assert mixing.mixed(docs, block_rows=4, shard_words=50).count() == len(drawn)


def test_a_long_document_leaves_no_target_short(spark):
    """Wherever a source's long one lies, what its block cannot fill is filled from the blocks after it; rows without an id of their own share no block."""
    rows = [(k * 1000 + i, "w " * (12_000 if i == 10 * k else 40), f"s{k:02}") for k in range(12) for i in range(161)]
    rows += [(None if i % 2 else 5, "w", "t") for i in range(400)]
    placed, mix = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_rows=20)
    times = Counter(r._row for r in mix.select("_row").collect())
    words, free, target, dealt = Counter(), {}, {}, Counter()
    for r in placed.collect():
        target[r.idx] = r.target
        dealt[r.idx, r.block] += 1
        words[r.idx] += r.size * times[r._row]
        if times[r._row] <= r.turns:
            free[r.idx] = min(r.size, free.get(r.idx, r.size))
    assert len(target) == 13 and all(target[i] - free.get(i, 1) < words[i] <= target[i] + 1e-6 for i in target)
    assert mix.count() == mix.select("_row", "turn").distinct().count()
    assert max(dealt.values()) < 60


def test_splitting_draws_are_hypergeometric(spark):
    good, bad, draws, n = 12, 30, 17, 4000
    sql = mixing.hypergeometric(str(good), str(bad), str(draws), f"((id + 0.5D) / {n}D)")
    got = Counter(r.x for r in spark.range(n).selectExpr(f"{sql} as x").collect())
    from math import comb
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if k <= good else 0
        assert abs(got[k] / n - p) <= 1 / n + 1e-9
    edges = spark.sql(f"select {mixing.hypergeometric('0', '5', '3', '0.4D')} a, {mixing.hypergeometric('5', '0', '3', '0.4D')} b, {mixing.hypergeometric('4', '4', '8', '0.9D')} c, "
                      f"{mixing.hypergeometric('0', '0', '0', '0.9D')} d").first()
    assert tuple(edges) == (0, 3, 4, 0)


# --- packing ---


def test_packing_keeps_texts_whole_and_bins_compatible(docs):
    out = packing.pack(docs, capacity=40, most_sources=2, group_rows=20)
    rows, texts = out.collect(), Counter(r[1] or "" for r in sample())
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r._row].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 40
        assert len({r.source for r in held}) <= 2
        at = 0
        for r in sorted(held, key=lambda r: (r.before, r.n_words)):
            assert r.before == at
            at += r.n_words
    whole = Counter()
    made = packing.sequences(docs, out).collect()
    assert sum(len(s.texts) for s in made) == len(rows)
    numbered = {r._row: r.text or "" for r in docs.select("text").withColumn("_row", F.monotonically_increasing_id()).collect()}
    for row, held in pieces.items():
        whole["".join(numbered[row][r.start:r.stop] for r in sorted(held, key=lambda r: r.piece))] += 1
    assert whole == texts
    for held in bins.values():
        kept = [numbered[r._row][r.start:r.stop].encode().translate(LOW) for r in held]
        assert len(set(kept)) == len(kept)


def test_pieces_are_not_sent_to_the_driver(docs, sent):
    out = packing.pack(docs, capacity=40, group_rows=20)
    assert not sent(out)
    assert out.select("_row").distinct().count() == len(sample())


def test_the_tightest_compatible_bin_is_found():
    bins = packing.Bins(10, 2)
    assert bins.put(6, 0, 1) == (0, 0)
    assert bins.put(7, 0, 2) == (1, 0)
    assert bins.put(3, 1, 3) == (1, 7)
    assert bins.put(4, 0, 1) == (2, 0)  # bin 0 would be full but holds the cluster
    assert bins.put(4, 1, 65) == (0, 6)
    assert bins.put(1, 2, 9) == (2, 4)
    assert bins.put(1, 3, 10) == (3, 0)  # bin 2 has two sources


# --- suffix array ---


def test_transform_is_the_collections(spark):
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.choice(list(b"abc"), rng.integers(1, 9))) for _ in range(12)]
    bwt, lcp, _ = suffix.transform(pieces)
    every = sorted((((tuple(p[i:])) + ((-1, k),), k, i) for k, p in enumerate(pieces) for i in range(len(p) + 1)), key=lambda s: [(x, 0) if isinstance(x, int) else (-1, x[1]) for x in s[0]])
    assert bytes(bwt) == bytes(255 if i == 0 else pieces[k][i - 1] for _, k, i in every)
    for n, (a, b) in enumerate(zip(every, every[1:], strict=False), 1):
        same = 0
        while same < min(len(a[0]), len(b[0])) - 1 and a[0][same] == b[0][same]:
            same += 1
        assert lcp[n] == same


def plain_spans(rows: list[tuple]) -> dict:
    seen, out = set(), {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i:i + 100]
            if window in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(window)
        out[doc_id] = (len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix.HOT_PIECES, 2])
def test_repeated_spans_equal_a_plain_walk(spark, tmp_path, hot):
    rng = np.random.default_rng(9)
    base = "".join(chr(int(c)) for c in rng.integers(97, 123, 900)) + "héß" * 40
    texts = []
    for _ in range(25):
        a, b = sorted(rng.integers(0, len(base), 2).tolist())
        texts.append(base[a:b] + "".join(chr(int(c)) for c in rng.integers(97, 123, int(rng.integers(0, 150)))))
    texts += [texts[0], None, "", "z" * 1000, "zy" * 300, base[:99], base[:100], base[:500] + "!" + base[501:]]
    rows = [(i, t) for i, t in enumerate(texts)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_spans(spark.read.parquet(path), hot).collect()}
    assert got == plain_spans(rows)


def test_rows_of_one_or_no_id_lose_their_repetition_once(docs):
    rows = suffix.repeated_spans(docs).collect()
    assert len(rows) == len(sample())
    twice = [r for r in rows if r.doc_id == 7]
    assert len(twice) == 3 and sorted(r.n_removed for r in twice)[0] < twice[0].n_bytes


# --- language model ---


def test_pairs_smooth_to_one_and_scores_add_up(docs):
    rows = lm.perplexities(docs).collect()
    assert len(rows) == len(sample())
    assert all(r.n_tokens >= 1 and r.score <= 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    model = lm.train(texts, 1 << 16)
    words = sorted({w for r in sample() for w in low(r[1]).split()})
    for before in (b"amber", b"unseen"):
        texts = [before + b" " + w for w in [*words, b"unknown"]]
        sizes, _, _, logs = model.token_scores(texts)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        after = [*logs[at + 1], model.token_scores([before])[3][1]]
        assert sum(10 ** x for x in after) == pytest.approx(1, abs=1e-9)


# --- personal data ---


def test_contexts_find_unseen_identifiers(spark):
    known = [(i, f"filler words here write to mailbox user{i}@site{i}.example.org before noon please") for i in range(40)]
    odd = [(100, "filler words here write to mailbox someone4@localhost before noon please"), (101, "some other place holds 77x quietly"), (102, None), (103, "")]
    rows = spark.createDataFrame(known + odd, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(rows).collect()}
    text = dict(odd)[100]
    at = text.index("someone4@localhost")
    assert got[100].spans == f"email:{at}:{at + 18}" and got[100].n_email == 0
    assert got[101].spans == got[102].spans == got[103].spans == ""
    assert all(got[i].n_email == 1 and got[i].spans.count(":") == 2 for i, _ in known)


def test_forms_without_walking_back(spark):
    texts = ["a@b.c.@d.e x", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "+1 (22) 333-4444- z", "4111 1111 1111 1111 x", "9" * 5000 + "." + "1." * 300, "a" * 30000 + "@b.c",
             "é+1 (743) 555-3824. 4111-1111-1111-1111", " +", "@@a@@b.c", "x@y.z-w.q_r@s.t", "𝔘x 1.1.1.1 é 2.2.2.2"]
    got = defaultdict(list)
    for r in pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "_row long, text string")).collect():
        got[r._row].append((r.kind, r.start, r.end))
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == 0:
            return True
        if kind == 1:
            return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted((k, m.start(), m.end()) for k, p in enumerate(plain) for m in re.finditer(p, t) if fine(k, m[0]))


# --- toxicity ---


def test_toxic_words_are_told_from_ordinary_ones(spark):
    rng = np.random.default_rng(1)
    usual = ["meadow", "lantern", "harbor", "cobalt", "thimble", "orchard", "saddle", "pebble"]
    rows = []
    for i in range(400):
        words = list(rng.choice(usual, 60))
        if i % 4 == 0:
            for at in rng.choice(60, 5, replace=False):
                words[at] = ["grobnik", "vashtul"][int(rng.integers(0, 2))]
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows] + [(None, None, None), (900, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in rows] + [(None, 1), (1, None), (2, 9)], "doc_id long, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and sum(p == t for p, t in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = toxicity.accepted(docs, labels)
    assert out.columns == docs.columns and 250 < out.count() < 340


def test_no_labels_and_one_class(docs, spark):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(docs, toxicity.train(docs, nothing)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.scores(docs, toxicity.train(docs, one)).count() == len(sample())


@pytest.mark.parametrize("seed", range(20))
def test_a_piece_goes_to_the_tightest_of_all_compatible_bins(seed):
    """Beside trying every bin: of equal residuals the one that has had its residual longest."""
    rng = np.random.default_rng(seed)
    capacity, most = 60, 2
    bins, plain_bins = packing.Bins(capacity, most), []
    for step in range(400):
        size, source, cluster = int(rng.integers(0, 40)), int(rng.integers(0, 5)), int(rng.integers(0, 200)) * 64 * int(rng.integers(0, 2)) + int(rng.integers(0, 90))
        fits = [(b["left"], b["since"], i) for i, b in enumerate(plain_bins)
                if b["left"] >= size and cluster not in b["clusters"] and len(b["sources"] | {source}) <= max(most, len(b["sources"]))]
        if fits:
            chosen = min(fits)[2]
        else:
            chosen = len(plain_bins)
            plain_bins.append({"left": capacity, "since": step, "clusters": set(), "sources": set()})
        b = plain_bins[chosen]
        assert bins.put(size, source, cluster) == (chosen, capacity - b["left"])
        b["left"], b["since"] = b["left"] - size, step
        b["clusters"].add(cluster)
        b["sources"].add(source)


def test_a_mix_is_the_same_whatever_files_its_rows_lie_in(spark, tmp_path):
    """Many texts of one size tie, some rows share an id or have none, some are repeated whole."""
    rng = np.random.default_rng(8)
    words = ["w", "x", "y", "zz"]
    rows = [(int(i) if i % 9 else None if i % 2 else 5, " ".join(rng.choice(words, 40 if i % 50 else 900)), "abcd"[i % 4]) for i in range(1500)]
    rows += [(5, "again and again", "a")] * 60 + [(None, "no id", "b")] * 60
    seen = []
    for n, order in ((1, "doc_id"), (7, "text"), (3, "source")):
        path = str(tmp_path / str(n))
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(n, order).write.parquet(path)
        docs = spark.read.parquet(path)
        mixed = [tuple(r) for r in mixing.mixed(docs, block_rows=16, shard_words=9000).collect()]
        seen.append((sorted(map(repr, mixing.taken(docs, block_rows=16).collect())), sorted(map(repr, mixed))))
        size = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "abcd"}
        aims = plain_targets(size)
        for s in "abcd":
            assert 0 <= aims[s] - sum(len(r[1].split()) for r in mixed if r[2] == s) < 41
    assert seen[0] == seen[1] == seen[2]


# --- rows whose splits change between jobs ---


def test_rows_keep_their_texts_when_splits_change_between_jobs(spark, docs, monkeypatch):
    """The files are cut anew at each job, as they are when executors come or go."""
    least, cut = "spark.sql.files.minPartitionNum", iter(range(1000))
    from pagewright.llm import common

    def moving(df, name, written=common.stored, **options):
        out = written(df, name, **options)
        spark.conf.set(least, "1" if next(cut) % 2 == 0 else "64")
        return out
    for module in (common, exact, simhash, mixing, pii, suffix):
        monkeypatch.setattr(module, "stored", moving)
    monkeypatch.setattr(suffix, "_compact", moving)
    rows, want = sample(), {low(r[1]) for r in sample()}
    calm = lambda run: sorted(map(repr, run().collect()))
    runs = (lambda: exact.exact_dedup(docs), lambda: pii.digests(docs), lambda: suffix.repeated_spans(docs), lambda: simhash.near_dedup(docs))
    try:
        spark.conf.set(least, "64")
        assert sorted(low(r.text) for r in exact.exact_dedup(docs).collect()) == sorted(want)
        groups = Counter(low(r[1]) for r in rows)
        spark.conf.set(least, "64")
        assert Counter(r.group_size for r in exact.exact_classes(docs).collect()) == Counter(groups[low(r[1])] for r in rows)
        spark.conf.set(least, "64")
        mixed = mixing.mixed(docs, block_rows=4, shard_words=50).collect()
        size = lambda r: len((r.text or "").split())
        full = Counter()
        for r in mixed:
            full[r.source] += size(r)
        sizes = Counter()
        for r in rows:
            sizes[r[3]] += len((r[1] or "").split())
        aims = plain_targets(sizes)
        assert all(full[s] <= aims[s] + 1e-6 for s in aims)
        first = []
        for run in runs:
            spark.conf.set(least, "64")
            first.append(calm(run))
    finally:
        spark.conf.unset(least)
        monkeypatch.undo()
    assert [calm(run) for run in runs] == first


# --- empty tables ---


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (exact.exact_classes(none), exact.exact_dedup(none), simhash.near_classes(none), simhash.near_dedup(none), mixing.taken(none), mixing.mixed(none), packing.pack(none),
                suffix.repeated_spans(none), lm.perplexities(none), pii.digests(none), toxicity.scores(none, toxicity.train(none, labels)), toxicity.accepted(none, labels)):
        assert out.count() == 0
