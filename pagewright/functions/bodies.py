"""What a response body is: its kind, whether it was decoded wrongly, whether it is a bot check."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types by the kind of body they name.
HTML_TYPES = ["text/html", "application/xhtml+xml"]
MARKDOWN_TYPES = ["text/markdown", "text/x-markdown"]
JSONL_TYPES = ["application/x-ndjson", "application/ndjson", "application/jsonl", "application/x-jsonlines"]
JSON_TYPES = ["application/json", "text/json"]
XML_TYPES = ["application/xml", "text/xml"]
# Names of UTF-8.
UTF8_NAMES = ["utf-8", "utf8", "unicode-1-1-utf-8"]
# Markup only a bot check carries. The passive script under /scripts/jsd/ is on ordinary pages too.
CHALLENGE_PATTERN = (r"(?i)<title>\s*just a moment\.\.\.|id=[\"']challenge-running|id=[\"']challenge-body-text"
                     r"|/cdn-cgi/challenge-platform/h/")
# Fixed value: replacement characters from which a page's own text can be judged.
MANY_REPLACED = 20

REPLACEMENT = "�"
# One leading blank, comment or XML declaration. Anchored at the end of the previous match, so a banner of any number of
# comments is peeled off one match at a time, in linear time and without recursion.
LEADING_NOISE = r"(?s)\G(?:[\s\x{FEFF}]+|<!--.*?-->|<\?xml.*?\?>)"
HTML_START = r"(?i)^<(?:!doctype\s+html|html|head|body|meta)[\s>/]"


def media_type(content_type: Column) -> Column:
    return F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def html_sniff(body: Column) -> Column:
    """Whether the body opens as an HTML document, after a byte-order mark, an XML declaration, blanks and comments."""
    return F.regexp_replace(body, F.lit(LEADING_NOISE), F.lit("")).rlike(HTML_START)


def body_kind(content_type: Column, body: Column) -> Column:
    """``html``, ``markdown``, ``text``, ``json``, ``jsonl``, ``xml`` or ``file``.

    The content type decides; a body that claims to be data, or claims nothing, is looked at, because an error or login
    page is often served under the type of the data that was asked for.
    """
    media = media_type(content_type)
    claimed = (F.when(media.isin(HTML_TYPES), "html")
               .when(media.isin(MARKDOWN_TYPES), "markdown")
               .when(media.isin(JSONL_TYPES), "jsonl")
               .when(media.isin(JSON_TYPES) | media.endswith("+json"), "json")
               .when(media.isin(XML_TYPES) | media.endswith("+xml"), "xml")
               .when(media.startswith("text/") | (media == ""), "text")
               .otherwise("file"))
    looked_at = claimed.isin("json", "jsonl", "xml") | (media == "")
    return F.when(looked_at & html_sniff(F.coalesce(body, F.lit(""))), "html").otherwise(claimed)


def replacement_chars(body: Column) -> Column:
    return (F.length(body) - F.length(F.replace(body, F.lit(REPLACEMENT), F.lit("")))).cast("long")


def surviving_non_ascii(body: Column) -> Column:
    """Characters outside ASCII that are not replacement characters."""
    return F.length(F.regexp_replace(body, r"[\x00-\x7F\x{FFFD}]+", "")).cast("long")


def header_charset(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))


def meta_charset(body: Column) -> Column:
    """The charset of a real ``<meta>`` tag: one named on a script or in the page's text declares nothing."""
    return F.lower(F.regexp_extract(body, r"(?i)<meta\b[^>]*\bcharset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1))


def xml_charset(body: Column) -> Column:
    return F.lower(F.regexp_extract(body, r"(?i)^[\s\x{FEFF}]*<\?xml[^>]*\bencoding\s*=\s*[\"']([^\"']+)", 1))


def _other(charset: Column) -> Column:
    return (charset != "") & ~charset.isin(UTF8_NAMES)


def not_utf8(body: Column, content_type: Column, kind: Column) -> Column:
    """Whether a body read as UTF-8 was written in something else.

    A declared other charset makes one replacement character enough. Without one, an HTML page is misread when it holds
    many of them and they outnumber the characters outside ASCII that survived. Data is judged by its declaration alone.
    """
    replaced = replacement_chars(body)
    declared = _other(header_charset(content_type)) | _other(xml_charset(body))
    html = (((declared | _other(meta_charset(body))) & (replaced >= 1))
            | ((replaced >= MANY_REPLACED) & (replaced > surviving_non_ascii(body))))
    # the count is the cheap test and almost always zero: the regexes run on the rest only
    return F.when(F.coalesce(replaced, F.lit(0)) == 0, F.lit(False)).when(kind == "html", html).otherwise(declared)


def is_challenge(body: Column) -> Column:
    """A bot check, told by its raw markup: however wordy it is, and whatever it would convert to."""
    return F.coalesce(body, F.lit("")).rlike(CHALLENGE_PATTERN)
