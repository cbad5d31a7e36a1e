"""What each response was: status, saving, document types, names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.bodies import body_kind, html_sniff, is_challenge, not_utf8
from pagewright.functions.markup import markdown_title, text_in, title_in, without_scripts
from pagewright.functions.text import glob_pattern, word_count
from pagewright.functions.urls import SLUG_CHARS, url_slug
from pagewright.operators.ordered import numbered, salted_join

#: Words under which an HTML page counts as a shell that still has to be rendered.
MIN_WORDS = 80
NOT_UTF8 = "the response is not UTF-8"
# The extension each kind of text is saved under.
EXTENSIONS = {"html": ".md", "markdown": ".md", "text": ".md", "json": ".json", "jsonl": ".jsonl", "xml": ".xml"}
# First bytes of document formats, in hex.
MAGIC_PDF = "255044462D"
MAGIC_ZIP = "504B0304"
MAGIC_OLE = "D0CF11E0A1B11AE1"
ZIP_TYPES = ["docx", "pptx", "xlsx", "epub", "zip", "odt", "ods", "odp", "hwpx"]
OLE_TYPES = ["doc", "xls", "ppt", "hwp"]
HWP_SIGNATURE = "HWP Document File"
HWPX_MIMETYPE = "application/hwp+zip"


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _body_facts(df: DataFrame) -> DataFrame:
    """Facts of a body read by more than one rule, each computed once."""
    text = F.coalesce(_column(df, "text"), F.lit(""))
    kind = F.when(F.col("kind") == "text", body_kind(F.col("content_type"), text)).otherwise(F.col("kind"))
    return (df.withColumn("body_kind", kind)
            .withColumn("_challenge", (F.col("body_kind") == "html") & is_challenge(text))
            .withColumn("_misread", (F.col("kind") == "text") & not_utf8(text, F.col("content_type"), F.col("body_kind"))))


def page_status(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The outcome of each response: ``status, error, words, title, ext, savable`` beside the columns of ``df``.

    The rules hold in this order: a failed attempt; an HTTP refusal; a bot check, before anything is converted; a document
    and its verdict; a wrong charset; an empty body; an HTML page with too few words; else a page that was read.
    ``doc_status``/``doc_error`` (see ``doc_triage``) and ``via`` are used where ``df`` has them.
    """
    facts = _body_facts(df.withColumnRenamed("status", "http_status"))
    text = F.coalesce(_column(facts, "text"), F.lit(""))
    via = F.coalesce(_column(facts, "via"), F.lit("fetch"))
    is_html = F.col("body_kind") == "html"
    # main text is only worth its regexes where the cheap rules have not decided already
    readable = is_html & (F.col("kind") == "text") & (F.col("http_status") < 400) & ~F.col("_challenge") & ~F.col("_misread")
    read = (facts.withColumn("_markup", F.when(readable, without_scripts(text)))
            .withColumn("_main", F.when(readable, text_in(F.col("_markup")))
                        .when(F.col("body_kind").isin("markdown", "text"), text))
            .withColumn("words", F.when(F.col("_main").isNotNull(), word_count(F.col("_main"))).otherwise(0).cast("long")))
    doc_status = _column(read, "doc_status")
    blank = ~text.rlike(r"\S")
    few = F.concat(F.lit("only "), F.col("words").cast("string"), F.lit(" words extracted"))
    rules = [
        (F.col("kind") == "error", "error", _column(read, "error")),
        (F.col("http_status") >= 400, "blocked", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))),
        (F.col("_challenge"), "challenge", F.lit("a bot check answered instead of the page")),
        ((F.col("kind") == "file") & doc_status.isNotNull(), doc_status, _column(read, "doc_error")),
        (F.col("kind") == "file", "ok", F.lit(None).cast("string")),
        (F.col("_misread"), F.when(is_html, "shell").otherwise("unsupported"), F.lit(NOT_UTF8)),
        (F.col("body_kind") == "file", "unsupported", F.lit("not a text this can read")),
        (~is_html & blank, "error", F.lit("the response is empty")),
        (is_html & (F.col("words") < min_words),
         F.when(via == "tab", "shell_escalated").otherwise("shell"), few),
    ]
    status, error = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, name, reason in rules[1:]:
        status, error = status.when(condition, name), error.when(condition, reason)
    title = (F.when(F.col("_markup").isNotNull(), title_in(F.col("_markup")))
             .when(F.col("body_kind") == "markdown", markdown_title(text)).otherwise(F.lit("")))
    ext = F.coalesce(*(F.when(F.col("body_kind") == kind, e) for kind, e in EXTENSIONS.items()), F.lit(".md"))
    return (read.withColumn("status", status.otherwise("ok"))
            .withColumn("error", error)
            .withColumn("title", title)
            .withColumn("via", via)
            .withColumn("ext", ext)
            .withColumn("savable", F.col("status") == "ok")
            .withColumnRenamed("_main", "content")
            .drop("_challenge", "_misread", "_markup"))


def save_as_html(df: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Outcomes when the document itself was asked for: HTML is saved even where no article is in it.

    A bot check, a misread page and a refusal stay unsaved, and a response that is not HTML is unsupported: a ``.html``
    file must hold HTML.
    """
    judged = page_status(df, min_words)
    answered = (F.col("kind") != "error") & (F.col("http_status") < 400)
    other = answered & (F.col("body_kind") != "html")
    saved = answered & ~other & (F.col("status") != "challenge") & ~F.coalesce(F.col("error") == NOT_UTF8, F.lit(False))
    return (judged.withColumn("savable", saved)
            .withColumn("error", F.when(other, "the response is not HTML").otherwise(F.col("error")))
            .withColumn("status", F.when(other, "unsupported").otherwise(F.col("status")))
            .withColumn("ext", F.lit(".html")))


def doc_triage(df: DataFrame) -> DataFrame:
    """What each binary response really is, by its first bytes: ``real_ext, doc_status, doc_error`` beside ``df``.

    Nothing is decoded: a document passes with its real extension, one that is not what it claims is unsupported, one
    whose bytes cannot be had is an error.
    """
    held = F.try_to_binary(F.col("body_b64"), F.lit("base64"))
    judged = (df.filter(F.col("kind") == "file").withColumn("_bytes", held)
              .withColumn("_magic", F.hex(F.substring(F.col("_bytes"), 1, 8)))
              .withColumn("_whole", F.decode(F.col("_bytes"), "ISO-8859-1")))
    claimed = F.lower(F.coalesce(F.col("ext"), F.lit("")))
    magic, whole = F.col("_magic"), F.col("_whole")
    # a zip's first entry: its name follows the 30-byte local header, its stored content follows the name
    first_entry_hwpx = (F.substring(whole, 31, 8) == "mimetype") & (F.substring(whole, 39, len(HWPX_MIMETYPE)) == HWPX_MIMETYPE)
    hwp = _signed_stream(whole)
    html = html_sniff(whole)
    real = (F.when(magic.startswith(MAGIC_PDF), "pdf")
            .when(magic.startswith(MAGIC_ZIP) & first_entry_hwpx, "hwpx")
            .when(magic.startswith(MAGIC_ZIP), F.when(claimed.isin(ZIP_TYPES) & (claimed != "hwpx"), claimed).otherwise("zip"))
            .when((magic == MAGIC_OLE) & hwp, "hwp")
            .when(magic == MAGIC_OLE, F.when(claimed.isin(OLE_TYPES) & (claimed != "hwp"), claimed).otherwise("ole"))
            .when(html, "html").otherwise(claimed))
    status = (F.when(F.col("_bytes").isNull(), "error")
              .when(F.length("_bytes") == 0, "unsupported")
              .when(F.col("real_ext") == "html", "unsupported")
              .when(claimed.isin("pdf") & (F.col("real_ext") != claimed), "unsupported")
              .when(claimed.isin(ZIP_TYPES) & ~magic.startswith(MAGIC_ZIP), "unsupported")
              .when(F.col("real_ext").isin("zip", "ole"), "unsupported")
              .otherwise("ok"))
    reason = (F.when(F.col("_bytes").isNull(), "the response could not be decoded")
              .when(F.length("_bytes") == 0, "the document is empty")
              .when(F.col("doc_status") == "unsupported",
                    F.concat(F.lit("claims to be "), F.when(claimed == "", "a document").otherwise(claimed),
                             F.lit(", is "), F.when(F.col("real_ext") == claimed, "something else").otherwise(F.col("real_ext")))))
    return (judged.withColumn("real_ext", F.when(F.col("_bytes").isNotNull(), real))
            .withColumn("doc_status", status).withColumn("doc_error", reason)
            .drop("_bytes", "_magic", "_whole"))


def _signed_stream(whole: Column) -> Column:
    """Whether any copy of the signature starts a stream of an OLE file, which lies on a 64-byte boundary."""
    before = F.transform(F.split(whole, HWP_SIGNATURE, -1), F.length)
    walked = F.aggregate(F.slice(before, 1, F.size(before) - 1), F.struct(F.lit(0).alias("at"), F.lit(False).alias("found")), lambda a, n: F.struct(
        (a["at"] + n + len(HWP_SIGNATURE)).alias("at"), (a["found"] | ((a["at"] + n) % 64 == 0)).alias("found")))
    return walked["found"]


def _bare_glob(glob: str) -> str:
    for scheme in ("https://", "http://"):
        if glob.startswith(scheme + "www."):
            return scheme + glob[len(scheme) + 4:]
    return glob


def glob_filter(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                column: str = "url") -> DataFrame:
    """The rows whose URL an include glob names and no exclude glob does.

    A glob written with or without ``www.`` selects a page under both names. Apply it to a listing that is already
    walked: a filtered page is still a way to other pages.
    """
    url = F.col(column)
    bare = F.regexp_replace(url, r"^(https?://)www\.", "$1")

    def named(globs: list[str]) -> Column:
        found = F.lit(False)
        for glob in globs:
            found = found | url.rlike(glob_pattern(glob)) | bare.rlike(glob_pattern(_bare_glob(glob)))
        return found

    kept = named(include) if include else F.lit(True)
    return df.filter(kept & ~named(exclude or []))


def status_counts(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return items.groupBy(*(keys or []), "status").agg(F.count("*").alias("n"))


def unique_slug(df: DataFrame) -> DataFrame:
    """A file name for each distinct URL of ``df``; URLs that share one keep it apart.

    The first URL of a shared name has it; the others carry a digest of their URL. Which one is first comes from an
    aggregation, so a name shared by a large part of all URLs is no group anywhere.
    """
    named = df.withColumn("_slug", url_slug(F.col("url")))
    shared = (named.groupBy("_slug").agg(F.min("url").alias("_first"), F.max("url").alias("_last"))
              .filter(F.col("_first") != F.col("_last")).drop("_last"))
    joined = salted_join(named, shared, ["_slug"], F.col("url"), how="left")
    digest = F.md5(F.col("url"))
    stem = F.regexp_replace(F.col("_slug"), r"\.md$", "")
    apart = F.concat(F.regexp_replace(F.substring(stem, 1, SLUG_CHARS - 33), r"-+$", ""), F.lit("-"), digest, F.lit(".md"))
    plain = F.col("_first").isNull() | (F.col("_first") == F.col("url"))
    return joined.withColumn("file", F.when(plain, F.col("_slug")).otherwise(apart)).drop("_slug", "_first")


def crawl_number(df: DataFrame, keys: list[str], position: str = "ord", digits: int = 3) -> DataFrame:
    """The page's number in its crawl, and the ``NNN-`` its file name starts with."""
    from pagewright.operators.ordered import chunk_of
    placed = numbered(df, keys, [F.col(position), F.col("url")], "n", chunk_of(F.col(position)))
    text = F.col("n").cast("string")
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return placed.withColumn("number", F.concat(padded, F.lit("-")))
