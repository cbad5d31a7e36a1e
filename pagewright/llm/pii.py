r"""Personal data: patterned kinds, and identifiers found by bootstrapping their contexts.

Four kinds have a form of their own (e-mail, IP address, card, phone); their matches are the seeds. A *mention* is a run of words that hold a digit or an at sign. Its
contexts are the two words before it and the two after it. Seeds' contexts become patterns; patterns and mentions make a graph, scored in rounds: a
pattern's score for a kind is the mean weight of the different mentions in it, a mention's weight for a kind is the chance that not all of its good
patterns err. Mentions that reach ``SURE`` are identifiers of that kind where they stand in a good pattern. All of it is DataFrame functions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import numbered, text_of
from pagewright.session import stored

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and starts at the start of a run give the same matches as the plain forms, without going over a run again and again.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that does not match has none of the kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
#: What belongs to a mention's identifier: it starts and ends in a letter, a digit, a plus before or a bracket around a number.
CORE = r"[+(]?[\p{L}\p{N}](?:.*[\p{L}\p{N})])?"
ROUNDS = 3
#: Characters of a gap in which the words beside a mention are looked for; a longer word beside it is a context by its near end.
CONTEXT_CHARS = 64
#: Different known mentions a pattern needs, its least score, and the weight from which a mention is an identifier.
SUPPORT, GOOD, SURE = 5, 0.9, 0.95


def matches(docs: DataFrame, forms: list[tuple[int, str, str]], keys: list[str]) -> DataFrame:
    """``(keys, kind, i, gap, value)``: match ``i`` of each form ``(kind, regex, sign)``, and the text since the one before; one row more holds the text's rest.

    Splitting a text by a form and gathering its matches walk the same finds, so gaps and values alternate.
    """
    zipped = []
    for kind, form, sign in forms:
        has = F.col("text").contains(sign) if sign == "@" else F.col("text").rlike(sign)
        both = F.arrays_zip(F.split("text", form, -1).alias("gap"), F.regexp_extract_all("text", F.lit(form), F.lit(0)).alias("value"))
        zipped.append(F.when(has, F.struct(F.lit(kind).alias("kind"), both.cast("array<struct<gap: string, value: string>>").alias("z"))))
    one = docs.select(*keys, F.explode(F.array(*zipped)).alias("f")).filter("f is not null")
    return one.select(*keys, "f.kind", F.posexplode("f.z").alias("i", "m")).select(*keys, "kind", "i", "m.gap", "m.value")


def _luhn(digits: Column) -> Column:
    back = F.reverse(F.split(digits, ""))
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == 0, F.lit(True)).when(kind == 1, value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(kind == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(9, 15)))


def base_spans(rows: DataFrame) -> DataFrame:
    """``(_row, kind, start, end, value)`` of the four kinds in the texts of ``(_row, text)``; ``kind`` is a place in ``KINDS``."""
    found = matches(rows, [(i, FORMS[k], SIGNS[k]) for i, k in enumerate(KINDS)], ["_row"]).select("_row", "kind", "i", F.length("gap").alias("gap"), "value")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = found.withColumn("end", upto.cast("long")).filter("value is not null").withColumn("start", F.col("end") - F.length("value"))
    return placed.filter(valid(F.col("kind"), F.col("value"))).select("_row", "kind", "start", "end", "value")


def mentions(rows: DataFrame) -> DataFrame:
    """``(_row, start, end, core, before, after)`` of each mention: its identifier's place and text, and its contexts in lower case, null where there is none."""
    found = matches(rows, [(0, MENTION, "[0-9@]")], ["_row"])
    # of a gap, however long, only its ends are kept
    ends = found.select("_row", "i", "value", F.length("gap").alias("gap"),
                        F.substring("gap", -CONTEXT_CHARS, CONTEXT_CHARS).alias("tail"), F.substring("gap", 1, CONTEXT_CHARS).alias("head"))
    order = Window.partitionBy("_row").orderBy("i")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = ends.withColumn("_end", upto.cast("long")).withColumn("after", F.lead("head").over(order)).filter("value is not null")
    core = F.regexp_extract("value", f"({CORE})", 1)
    shift = F.instr("value", core) - 1
    start = F.col("_end") - F.length("value") + shift
    return (placed.select("_row", start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), _word_pair("tail").alias("before"), _word_pair("after").alias("after"))
            .filter("core <> ''"))


def _word_pair(name: str) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}=:]+"), F.lit(0))
    pair = F.when(F.lit(name == "tail"), F.slice(words, -F.least(F.size(words), F.lit(2)), 2)).otherwise(F.slice(words, F.lit(1), F.lit(2)))
    return F.when(F.size(words) > 0, F.array_join(pair, " "))


def discovered(spans: DataFrame, found: DataFrame) -> DataFrame:
    """``(_row, kind, start, end, value)`` of identifiers that no form has, from the base spans and the mentions."""
    seeds = spans.groupBy("value", "kind").agg(F.lit(1.0).alias("weight")).withColumnRenamed("value", "core")
    either = F.array(F.concat(F.lit("before "), "before"), F.concat(F.lit("after "), "after"))
    held = stored(found.select("_row", "start", "end", "core", F.explode(either).alias("pattern")).filter("pattern is not null"), "held")
    edges = stored(held.select("pattern", "core").distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    edges = stored(edges.join(sizes, "pattern"), "edges")
    weights = seeds
    for _ in range(ROUNDS):
        scored = edges.join(weights, "core").groupBy("pattern", "n", "kind").agg(F.sum("weight").alias("w"), F.count(F.when(F.col("weight") >= SURE, 1)).alias("known"))
        good = stored(scored.filter((F.col("known") >= SUPPORT) & (F.col("w") / F.col("n") >= GOOD)).select("pattern", "kind", F.least(F.col("w") / F.col("n"), F.lit(0.99)).alias("score")), "patterns")
        new = edges.join(good, "pattern").groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("weight"))
        weights = stored(new.unionByName(seeds).groupBy("core", "kind").agg(F.max("weight").alias("weight")), "weights")
    unseen = weights.filter(F.col("weight") >= SURE).join(seeds.select("core").distinct(), "core", "left_anti")
    best = unseen.groupBy("core").agg(F.max_by("kind", F.struct("weight", (-F.col("kind")).alias("k"))).alias("kind"))
    return held.join(good, "pattern").join(best, ["core", "kind"]).select("_row", "kind", "start", "end", F.col("core").alias("value")).distinct()


def personal(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: every row's ``(_row, doc_id)``, and ``(_row, kind, start, end, value, base)``, discovered spans without those that touch a base one.

    Code points, end exclusive. A null text is empty and has none; a long one is read whole; rows repeated have their spans each; of kinds that tie for a discovered
    one the first in ``KINDS`` counts; an empty table has neither rows nor spans; other columns of ``docs`` are not looked at. ``docs`` is read once: ids and texts are written with ``_row``, a number for each row.
    """
    given = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    spans = stored(base_spans(given.select("_row", "text")), "spans")
    found = stored(mentions(given.select("_row", "text")), "mentions")
    more = stored(discovered(spans, found), "more")
    # a discovered span touches a base one if, in the order of starts, the furthest end before it is past its start or the next start is before its end
    line = spans.select("_row", "start", "end", F.lit(0).alias("new"), "kind", "value").unionByName(
        more.select("_row", "start", "end", F.lit(1).alias("new"), "kind", "value"))
    order = Window.partitionBy("_row").orderBy("start", "new", "end", "kind")
    past = F.max(F.when(F.col("new") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("new") == 0, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.col("new") == 0) | ((F.coalesce(past, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end")))
    kept = line.withColumn("_apart", apart).filter("_apart").select("_row", "kind", "start", "end", "value", (F.col("new") == 0).alias("base"))
    return given.select("_row", "doc_id"), kept


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row; counts are those of base spans."""
    rows, spans = personal(docs)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    item = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("s"))
    held = spans.groupBy("_row").agg(*(F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
                                     F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("_base"), F.array_sort(F.collect_list(item)).alias("_all"))
    joined = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<kind: int, start: bigint, end: bigint, s: string>>")), lambda x: x["s"]), ",")
    return rows.join(held, "_row", "left").select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
                                                  F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans"))
