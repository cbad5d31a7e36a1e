r"""Phrase mining after Toivonen: a sample proposes frequent phrases, a full pass counts them and their negative border, misses on the border lead to further passes.

A phrase is a run of words inside a piece of a text, counted within one language. It can only be frequent if what it is without its last and without its first
word are. Texts are cut into words once, and words counted over all of them first. The frequent ones, and the longer phrases frequent in the sample (at a lowered threshold), are kept as sorted hash
arrays in the shared folder, which workers map. A full pass counts, exactly and over every text, each longer phrase whose two shorter ones are known: the
sample's phrases themselves, and the negative border, those that a sample without them has just not reached. A border phrase that turns out frequent joins the known ones, and a further pass counts what it and its like
admit, until no border phrase is frequent. Counts are summed in a task's arrays and then by Spark; only frequent phrases are ever spelled out.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrays import mapped, place, save, work_folder
from pagewright.llm.common import ship_package, text_of
from pagewright.operators.ordered import first_n, salted_join
from pagewright.session import stored

MOST_WORDS = 4
#: Occurrences a candidate needs, and how many a language's list holds.
LEAST, LISTED = 30, 2000
#: One text of so many proposes; of the occurrences expected there a phrase needs ``LOWERED``, so that few frequent ones are missed.
SAMPLE_OF, LOWERED = 4, 0.7
#: Bytes of texts cut into words at once, words and counts a task holds, and phrases in one file of known ones.
AT_ONCE, HELD_WORDS, HELD_COUNTS, FILE_BITS = 1 << 18, 1 << 20, 1 << 21, 22
#: Tasks that rows of one hot phrase or word are dealt to, and copies of the other side.
SALTS = 4

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _SEPARATORS else 32 if b == 9 else b for b in range(256))
_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHECK = [np.uint64(2 * x + 1) for x in (0x2545F4914F6CDD1D, 0x1B03738712FAD5C9, 0x3C6EF372FE94F82B, 0x510E527FADE682D1)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def longer(prev: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of phrases from those of all but their last words and the hashes of these."""
    return mixed(prev * _K + last)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit hashes of each word: one makes keys, the other checks them."""
    both = np.array([divmod(xxhash.xxh3_128_intdigest(w), 1 << 64) for w in words], np.uint64).reshape(len(words), 2)
    return both[:, 0].copy(), both[:, 1].copy()


def start_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def phrase_key(lang: str, words: list[bytes]) -> tuple[int, int, int]:
    """A phrase's key, its check and its last word's hash."""
    a, b = word_hashes(words)
    key = np.array([start_of(lang)])
    with np.errstate(over="ignore"):
        for one in a:
            key = longer(key, np.array([one]))
        return int(key[0]), int((b * np.array(_CHECK[: len(words)])).sum(dtype=np.uint64)), int(a[-1])


def signed(values) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


@dataclass
class Known:
    """The known phrases as files: keys, ascending, their checks, and whether they became known just now. A file holds one number of words and one range of keys."""

    folder: str
    bits: int
    files: frozenset[int]

    def find(self, level: int, keys: np.ndarray, checks) -> tuple[np.ndarray, np.ndarray]:
        """Whether each phrase is known, and whether it is new. ``checks`` gives the checks at some places."""
        known, new = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for p in np.unique(part).tolist():
            name = (level << self.bits) + p
            if name not in self.files:
                continue
            here = np.flatnonzero(part == p)
            at, found = place(mapped(self.folder, f"key-{name}"), keys[here])
            at, here = at[found], here[found]
            same = mapped(self.folder, f"check-{name}")[at] == checks(here)
            known[here[same]] = True
            new[here[same]] = mapped(self.folder, f"new-{name}")[at[same]]
        return known, new


def summed(prev: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, and how often each comes."""
    order = np.argsort(longer(prev, last))
    prev, last = prev[order], last[order]
    first = np.flatnonzero(np.concatenate([[True], (prev[1:] != prev[:-1]) | (last[1:] != last[:-1])])) if len(prev) else np.zeros(0, np.int64)
    return prev[first], last[first], np.diff(np.append(first, len(prev)))


def _tokens(data: bytes) -> list[bytes]:
    """The words of texts, an empty one at each further blank, and a line feed where a piece ends."""
    return data.replace(b"\n", b" \n ").split(b" ")


def _in_turns(batches):
    """``(lang, sampled, bytes)`` of some texts of one language, a bounded number of bytes at a time; long texts are cut between pieces."""
    for batch in batches:
        held: dict[tuple[str, bool], list[bytes]] = {}
        size: Counter = Counter()
        for *key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            group = tuple(key)
            data, at = text.as_py().translate(_BYTES), 0
            while len(data) - at > AT_ONCE and (cut := data.find(b"\n", at + AT_ONCE)) >= 0:
                yield *group, data[at:cut]
                at = cut + 1
            held.setdefault(group, []).append(data[at:])
            size[group] += len(data) - at
            if size[group] > AT_ONCE:
                yield *group, b"\n".join(held.pop(group))
                del size[group]
        yield from ((*group, b"\n".join(texts)) for group, texts in held.items())


READ = "lang string, sampled boolean, tokens binary, a binary, b binary, word binary, n long"


def _read(batches):
    """Texts ``(lang, sampled, text)`` as rows of two kinds: some texts' tokens, numbers of the words whose hashes are beside them (0 where a piece ends), and counts of words."""
    counts: dict[str, Counter] = {}
    for lang, sampled, data in _in_turns(batches):
        tokens = _tokens(data)
        found = Counter(tokens)
        found.pop(b"", None)
        found.pop(b"\n", None)
        number = {word: i for i, word in enumerate(found, 1)}
        number[b""], number[b"\n"] = -1, 0
        tokens = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
        a, b = word_hashes(list(found))
        yield _read_rows([lang], [sampled], [tokens[tokens >= 0].tobytes()], [a.tobytes()], [b.tobytes()], [None], [None])
        counts.setdefault(lang, Counter()).update(found)
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from _word_rows(counts)
            counts = {}
    yield from _word_rows(counts)


def _word_rows(counts: dict[str, Counter]):
    for lang, found in counts.items():
        # a row without a word holds the number of all
        n = len(found) + 1
        yield _read_rows([lang] * n, *[[None] * n] * 4, [None, *found], [found.total(), *found.values()])


def _read_rows(*columns: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [part.split()[0] for part in READ.split(", ")])


def words_of(read: DataFrame, least: int) -> DataFrame:
    """``(lang, word, n)``: words that occur ``least`` times, and in a row without a word how many all are."""
    met = read.filter("tokens is null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return stored(met.filter((F.col("n") >= least) | F.col("word").isNull()).select("lang", F.col("word").cast("string").alias("word"), "n"), "words")


class _Counts:
    """What one task counts: phrases of the levels asked for whose two shorter ones are known, one of them anew."""

    def __init__(self, known: Known, levels: list[int]):
        self.known, self.levels = known, levels
        self.pairs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in levels}
        self.held = 0

    def add(self, lang: str, tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Tokens are numbers of words, from 1, and 0 where a piece ends; ``a`` and ``b`` the words' hashes."""
        word = longer(np.full(len(a), start_of(lang)), a)
        found, anew = self.known.find(1, word, lambda at: b[at] * _CHECK[0])
        # number 0 is no word: it is not known, and so in no phrase
        a, b, word = (np.concatenate([np.zeros(1, np.uint64), x]) for x in (a, b, word))
        found, anew = np.concatenate([[False], found]), np.concatenate([[False], anew])
        places, known, new = np.arange(len(tokens)), found[tokens], anew[tokens]
        key = word[tokens]
        for level in range(2, max(self.levels) + 1):
            # a place stands for the phrase of ``level`` words from there: what it is without its last word is there, without its first one place on
            both = np.flatnonzero(known[:-1] & known[1:] & (places[1:] == places[:-1] + 1))
            at = places[both]
            prev, last = key[both], a[tokens[at + level - 1]]
            if level in self.levels:
                fresh = np.flatnonzero(new[both] | new[both + 1])
                if len(fresh):
                    self.pairs[level].append((prev, last) if len(fresh) == len(at) else (prev[fresh], last[fresh]))
                    self.held += len(fresh)
            if level < max(self.levels):
                key = longer(prev, last)
                checks = lambda some, at=at, level=level: sum((b[tokens[at[some] + j]] * _CHECK[j] for j in range(level)), np.zeros(len(some), np.uint64))
                known, new = self.known.find(level, key, checks)
                # only what is known can be part of something longer
                places, key, new, known = at[known], key[known], new[known], known[known]

    def full(self) -> bool:
        return self.held > HELD_COUNTS

    def rows(self):
        """Batches of all counts held, which are then forgotten."""
        for level, parts in self.pairs.items():
            if parts:
                prev, last, n = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), level, np.int32)), pa.array(prev.view(np.int64)), pa.array(last.view(np.int64)), pa.array(n)],
                                                 ["level", "prev", "last", "n"])
        self.pairs, self.held = {k: [] for k in self.levels}, 0


def _counter(known: Known, levels: list[int]):
    def counter(batches):
        counts = _Counts(known, levels)
        with np.errstate(over="ignore"):
            for batch in batches:
                for lang, *arrays in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                    tokens, a, b = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(arrays, (np.int32, np.uint64, np.uint64), strict=True))
                    counts.add(lang, tokens, a, b)
                    if counts.full():
                        yield from counts.rows()
            yield from counts.rows()
    return counter


def counts(read: DataFrame, known: Known, levels: list[int], least: int) -> DataFrame:
    """``(level, prev, last, n)``: phrases of the levels, whose two shorter ones are known and one new, counted at least ``least`` times in texts that were read."""
    met = read.filter("tokens is not null").select("lang", "tokens", "a", "b").mapInArrow(_counter(known, levels), "level int, prev long, last long, n long")
    # tasks have summed theirs; rows are dealt before Spark sums, so it need not look for equal ones among rows that hardly have any
    whole = met.repartition("prev", "last").groupBy("level", "prev", "last").agg(F.sum("n").alias("n"))
    return stored(whole.filter(F.col("n") >= least), "counts")


def _hashed(batches):
    for batch in batches:
        langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [phrase_key(lang, phrase.split(b" ")) for lang, phrase in zip(langs, phrases, strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), *(pa.array(signed(c), pa.int64()) for c in columns)],
                                         ["lang", "phrase", "level", "f", "key", "check", "last"])


def hashed(phrases: DataFrame) -> DataFrame:
    """Phrases ``(lang, phrase, level, f)`` with ``key``, ``check`` and ``last``, as workers make them from words."""
    return phrases.select("lang", F.col("phrase").cast("binary").alias("phrase"), "level", "f").mapInArrow(
        _hashed, "lang string, phrase binary, level int, f long, key long, check long, last long").withColumn("phrase", F.col("phrase").cast("string"))


def spelled(found: DataFrame, level: int, known: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, phrase, level, f)`` of counted phrases of ``level`` words. ``known`` and ``words`` are hashed phrases: those that hold what comes before the last word, and single words."""
    ends = words.select("lang", "last", F.col("phrase").alias("_last"))
    before = known.filter(F.col("level") == level - 1).select("lang", F.col("key").alias("prev"), F.col("phrase").alias("_prev"))
    here = found.filter(F.col("level") == level).select("prev", "last", F.col("n").alias("f"))
    one = salted_join(here, before, ["prev"], F.col("last"), salts=SALTS)
    two = salted_join(one, ends, ["lang", "last"], F.col("prev"), salts=SALTS)
    return two.select("lang", F.concat_ws(" ", "_prev", "_last").alias("phrase"), F.lit(level).alias("level"), "f")


def _saver(folder: str):
    def saver(batches):
        held: dict[int, list[list[int]]] = {}
        for batch in batches:
            for name, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(name, []).append(row)
        while held:
            name, rows = held.popitem()
            key, check, new = zip(*rows, strict=True)
            key, check = np.array(key, np.int64).view(np.uint64), np.array(check, np.int64).view(np.uint64)
            order = np.argsort(key)
            key = key[order]
            if (key[1:] == key[:-1]).any():
                raise ValueError("two phrases have one key of 64 bits")
            save(folder, f"check-{name}", check[order])
            save(folder, f"new-{name}", np.array(new, bool)[order])
            save(folder, f"key-{name}", key)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64())], ["name"])
    return saver


def known_phrases(phrases: DataFrame) -> Known:
    """Hashed phrases with ``new`` as files that workers map. A file has at most about ``2 ** FILE_BITS`` phrases; the driver gets a number for each file."""
    spark = phrases.sparkSession
    bits = max(0, phrases.count() >> FILE_BITS).bit_length()
    folder = work_folder(spark, "phrases")
    part = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    named = phrases.select((F.shiftleft(F.col("level").cast("long"), bits) + part).alias("name"), "key", "check", "new")
    files = named.repartition("name").mapInArrow(_saver(folder), "name long").collect()
    return Known(folder, bits, frozenset(r.name for r in files))


def frequent(docs: DataFrame, least: int = LEAST, sample_of: int = SAMPLE_OF) -> tuple[DataFrame, DataFrame, int]:
    """``(phrases, sizes, passes)``: every phrase of one to ``MOST_WORDS`` words that occurs ``least`` times in its language, ``(lang, phrase, level, f)``; ``(lang, n)``, all
    words of each language; and how many passes over all texts longer phrases took.

    The counts are those of all texts; the sample, texts chosen by a hash of their own, only decides what the first pass looks for.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), (F.pmod(F.xxhash64(text_of()), F.lit(sample_of)) == 0).alias("sampled"),
                        text_of().cast("binary").alias("text"))
    # texts are cut into words once
    read = stored(texts.mapInArrow(_read, READ), "tokens", compression="zstd")
    met = words_of(read, least)
    sizes = met.filter("word is null").select("lang", "n")
    words = stored(hashed(met.filter("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("level"), F.col("n").alias("f"))), "frequent")

    # words are known from all texts; the sample proposes what is longer
    sample = read.filter("sampled")
    lowered = max(2, int(least / sample_of * LOWERED))
    known = words
    for level in range(2, MOST_WORDS):
        found = counts(sample, known_phrases(known.withColumn("new", F.lit(True))), [level], lowered)
        known = known.unionByName(stored(hashed(spelled(found, level, known, words)), "proposed"))

    known, phrases, passes = stored(known.withColumn("new", F.lit(True)), "known"), words, 0
    while True:
        passes += 1
        found = counts(read, known_phrases(known), list(range(2, MOST_WORDS + 1)), least)
        here = spelled(found, 2, known, words)
        for level in range(3, MOST_WORDS + 1):
            here = here.unionByName(spelled(found, level, known, words))
        here = stored(hashed(here), "found")
        phrases = phrases.unionByName(here)
        missed = here.filter(F.col("level") < MOST_WORDS).join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti").withColumn("new", F.lit(True))
        missed = stored(missed.select(known.columns), "missed")
        if missed.isEmpty():
            return phrases.select("lang", "phrase", "level", "f"), sizes, passes
        known = stored(known.withColumn("new", F.lit(False)).unionByName(missed), "known")


def scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of phrases of two words or more, each at the cut between two of its words that scores lowest, then the first: ``2000000 a / (l + r)``, floored.
    Products run in decimals."""
    word = F.split("phrase", " ")
    cuts = phrases.filter("level > 1").select("lang", "phrase", F.col("f").alias("a"), word.alias("_w"), F.explode(F.sequence(F.lit(1), F.size(word) - 1)).alias("k"))
    joined = lambda part: F.array_join(part, " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("_w", F.lit(1), F.col("k"))).alias("_first"), joined(F.slice("_w", F.col("k") + 1, F.size("_w"))).alias("_rest"))
    for part, out in (("_first", "l"), ("_rest", "r")):
        cuts = salted_join(cuts, phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)), ["lang", part], F.col("phrase"), salts=SALTS)
    exact = F.expr("cast(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def inside(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, _most)``: phrases of two words or more inside longer ones, and the most occurrences one of these has."""
    word = F.split("phrase", " ")
    parts = F.expr("flatten(transform(sequence(2, size(_w) - 1), n -> transform(sequence(1, size(_w) - n + 1), i -> array_join(slice(_w, i, n), ' '))))")
    held = phrases.filter("level > 2").select("lang", "f", word.alias("_w")).select("lang", "f", F.explode(parts).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))


def listed(docs: DataFrame, least: int = LEAST, sample_of: int = SAMPLE_OF, most: int = LISTED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``most`` best phrases of two to ``MOST_WORDS`` words, by score, then ``a``, both descending, then phrase.

    Phrases inside a longer one with at least four fifths of their occurrences are not listed. A null language is ``und``, a null text empty; rows repeated count
    as often as they come; an empty table, and a language without a frequent phrase, lists nothing; ids and other columns are not looked at.
    """
    phrases, sizes, _ = frequent(docs, least, sample_of)
    phrases = stored(phrases, "phrases")
    whole = scored(phrases).join(inside(phrases), ["lang", "phrase"], "left")
    kept = whole.filter(F.coalesce(F.expr("cast(5 as decimal(1,0)) * cast(_most as decimal(20,0)) < cast(4 as decimal(1,0)) * cast(a as decimal(20,0))"), F.lit(True)))
    ordered = kept.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    ranked = first_n(ordered, ["lang"], ["_s", "_a", "phrase"], most)
    return ranked.join(sizes, "lang").select("lang", F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
