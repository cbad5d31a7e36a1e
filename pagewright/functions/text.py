"""Words, previews, headers and labels."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Scripts written without spaces between words: Hangul, kana, Han.
CJK = r"\x{1100}-\x{11FF}\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
#: How many of a prompt's words its label keeps.
LABEL_WORDS = 4


def word_count(text: Column) -> Column:
    """Words of a text: runs of other characters count one each, two CJK characters count as one word."""
    # most texts hold no such character: one scan tells, and counting blanks apart is all that is left to do
    runs = F.regexp_count(text, F.lit(r"\S+"))
    others = F.regexp_count(F.regexp_replace(text, rf"[{CJK}]+", " "), F.lit(r"\S+"))
    cjk = F.length(text) - F.length(F.regexp_replace(text, rf"[{CJK}]+", ""))
    counted = F.when(text.rlike(rf"[{CJK}]"), others + F.floor((cjk + 1) / 2)).otherwise(runs)
    return F.coalesce(counted, F.lit(0)).cast("long")


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters and whether any were left out."""
    return F.struct(F.substring(text, 1, n).alias("content"), (F.length(text) > n).alias("truncated"))


def json_string(value: Column) -> Column:
    """A string as a JSON literal, on one line whatever it holds."""
    wrapped = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def frontmatter(url: Column, title: Column, via: Column) -> Column:
    """The header of a saved page: where its text came from."""
    return F.concat(F.lit("---\nurl: "), json_string(url), F.lit("\ntitle: "), json_string(title),
                    F.lit("\nvia: "), F.coalesce(via, F.lit("fetch")), F.lit("\n---\n\n"))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def run_label(prompt: Column) -> Column:
    """A name made of the prompt's own first words, composed (NFC) and safe as a path part. Only a prompt beyond ASCII goes to the Arrow UDF for NFC."""
    other = prompt.rlike(r"[^\x00-\x7F]")
    whole = F.when(other, _composed(F.when(other, prompt))).otherwise(prompt)
    words = F.filter(F.split(whole, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    label = F.array_join(F.slice(words, 1, LABEL_WORDS), "-")
    return F.when(label == "", "run").otherwise(label)


def glob_pattern(glob: str) -> str:
    """A shell-style pattern as an anchored regular expression; ``*`` crosses slashes."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"
