"""Answers as a reader wants them: citations and saved files resolved."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.operators.ordered import salted_join

# The tags an answer cites with.
TAG = re.compile(r"<(citation|quote)\b([^<>]*)>((?:(?!<(?:citation|quote)\b).)*?)</\1>", re.S)
IDS = r"(?:refs|ref|source)\s*=\s*\"([^\"]*)\""
# What may stand before a relative mention and after any.
MENTION = r"((?:sandbox:)?/[^\n\"'<>|]*?_[A-Za-z0-9]+/|(?<![^\s(\[<\"'`*])(?:sandbox:)?)artifacts/(?=([^\n]+))"
AFTER = r"^(?:$|(?![\w%/~-]|\.\w))"


def resolve_tags(text: str, urls: dict[str, str]) -> str:
    """A text with its citation tags replaced by what they hold and the URLs their ids name, innermost first."""
    def named(match: re.Match) -> str:
        held = match.group(3)
        ids = [i.strip() for found in re.findall(IDS, match.group(2)) for i in found.split(",")]
        fresh = [u for u in dict.fromkeys(urls[i] for i in ids if i in urls) if not re.search(r"[(, ]" + re.escape(u) + r"[,)]", held)]
        return f"{held} ({', '.join(fresh)})" if fresh else held

    done = TAG.sub(named, text)
    while done != text:
        text, done = done, TAG.sub(named, done)
    return done


@F.pandas_udf(StringType())
def _resolved(text: pd.Series, ids: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else resolve_tags(t, {} if i is None else dict(zip(i, u))) for t, i, u in zip(text, ids, urls)])


def resolve_citations(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """``(run_id, answer)`` with every tag resolved. ``ids`` holds ``(run_id, url, id)``.

    Only the ids an answer cites are gathered for it, so what the Arrow UDF gets is bounded by the answer's own text. An
    answer without tags never reaches Python.
    """
    tagged = F.contains("answer", F.lit("<citation")) | F.contains("answer", F.lit("<quote"))
    cited = (answers.filter(tagged).select("run_id", F.explode(F.regexp_extract_all("answer", F.lit(IDS), 1)).alias("_ids"))
             .select("run_id", F.explode(F.split("_ids", ",")).alias("_id")).select("run_id", F.trim("_id").alias("id")).distinct())
    known = ids.groupBy("run_id", "id").agg(F.min("url").alias("url"))
    found = (cited.join(known, ["run_id", "id"]).groupBy("run_id")
             .agg(F.collect_list(F.struct("id", "url")).alias("_found")))
    joined = answers.filter(tagged).join(found, "run_id", "left")
    resolved = joined.withColumn("answer", _resolved("answer", F.col("_found.id"), F.col("_found.url"))).drop("_found")
    return answers.filter(~tagged).unionByName(resolved)


def _forms(rel_path: F.Column) -> F.Column:
    """The ways an answer writes a path: as it is, with encoded blanks, fully encoded."""
    encoded = F.replace(F.replace(F.url_encode(rel_path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.array_distinct(F.array(rel_path, F.replace(rel_path, F.lit(" "), F.lit("%20")), encoded))


def artifact_mentions(answers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(run_id, session_id, rel_path, written)``: saved files an answer names, and the text it names each by.

    ``answers`` holds ``(run_id, author, answer)``: a path relative to ``artifacts/`` means the folder of the session that
    wrote the answer, an absolute one the session it names. ``artifacts`` holds ``(session_id, rel_path)``. A mention is
    not tried against a session's files: it offers a name of each length that session's names have, and they meet by equality.
    """
    found = answers.filter(F.contains("answer", F.lit("artifacts/"))).select(
        "run_id", "author", F.explode(F.arrays_zip(F.regexp_extract_all("answer", F.lit(MENTION), 1).alias("head"),
                                                   F.regexp_extract_all("answer", F.lit(MENTION), 2).alias("tail"))).alias("m"))
    folder = F.regexp_extract("m.head", r"_([A-Za-z0-9]+)/$", 1)
    forms = artifacts.select("session_id", "rel_path", F.explode(_forms(F.col("rel_path"))).alias("form"))
    lengths = forms.select("session_id", F.length("form").alias("_n")).distinct()
    tails = found.select("run_id", F.when(folder != "", folder).otherwise(F.col("author")).alias("session_id"), F.col("m.head").alias("head"), F.col("m.tail").alias("_tail"))
    ended = (F.length("_tail") >= F.col("_n")) & F.rlike(F.substring(F.col("_tail"), F.col("_n") + 1, F.lit(2)), F.lit(AFTER))
    mentions = salted_join(tails, lengths, ["session_id"], F.struct("run_id", "head", "_tail")).filter(ended).select(
        "run_id", "session_id", "head", F.expr("left(_tail, _n)").alias("form"))
    met = salted_join(mentions, forms, ["session_id", "form"], F.col("run_id"))
    return met.select("run_id", "session_id", "rel_path", F.concat("head", F.lit("artifacts/"), "form").alias("written")).distinct()


def referenced_artifacts(answers: DataFrame, artifacts: DataFrame, absolute_only: bool = False) -> DataFrame:
    """``(run_id, session_id, rel_path)``: the saved files an answer names."""
    named = artifact_mentions(answers, artifacts)
    if absolute_only:
        named = named.filter(F.regexp_replace("written", "^sandbox:", "").startswith("/"))
    return named.select("run_id", "session_id", "rel_path").distinct()


def rewrite_paths(text: str, copies: dict[str, str]) -> str:
    """A text with each written path replaced, the longest first, where it stands whole."""
    if not copies:
        return text
    written = "|".join(re.escape(w) for w in sorted(copies, key=len, reverse=True))
    return re.sub(rf"(?<![^\s(\[<\"'`*])({written})(?![A-Za-z0-9_%/~-]|\.[A-Za-z0-9_])", lambda m: copies[m.group(1)], text)


@F.pandas_udf(StringType())
def _rewritten(text: pd.Series, written: pd.Series, copies: pd.Series) -> pd.Series:
    return pd.Series([t if w is None else rewrite_paths(t, dict(zip(w, c))) for t, w, c in zip(text, written, copies)])


def rewrite_artifact_refs(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """``answers`` with the paths of ``refs`` ``(run_id, written, copy)`` replaced by their copies'.

    An answer's mentions are bounded by its own text.
    """
    found = refs.groupBy("run_id").agg(F.collect_set(F.struct("written", "copy")).alias("_m"))
    joined = answers.join(found, "run_id", "left")
    return joined.withColumn("answer", F.when(F.col("_m").isNotNull(), _rewritten("answer", F.col("_m.written"), F.col("_m.copy")))
                             .otherwise(F.col("answer"))).drop("_m")
