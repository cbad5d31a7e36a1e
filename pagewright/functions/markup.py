"""Titles, main text, Markdown and attribute values of HTML."""
from __future__ import annotations

import html
import re
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.urls import let

# Never text, closed or not: a browser, too, reads an unclosed script to the end.
NOT_TEXT = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
            r"|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)|<svg\b.*?(?:</svg\s*>|\z)")
# These only where they are closed: an unclosed menu must not take the article with it. A footer may run to the end.
AROUND_TEXT = (r"(?is)<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?(?:</footer\s*>|\z)"
               r"|<aside\b.*?</aside\s*>|<form\b.*?</form\s*>"
               r"|<div\b[^>]*\bclass=\"(?:ad|ads|advert|advertisement)\"[^>]*>[^<]*(?:</div\s*>|\z)")
# All of a page around its first article or main part that is not empty.
ARTICLE = (r"(?is)\A.*?<(?:article|main)\b[^>]*>(?!\s*</(?:article|main)\s*>)(.*?)(?:</(?:article|main)\s*>.*|\z)")
BREAKS = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|section|article|main|blockquote|pre|td|th)\b[^>]*>"
H1 = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _entity(found: Column) -> Column:
    """What one entity stands for; one of an unknown name stays as it is, and a number that is no character is a replacement character."""
    names = F.create_map(*(F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, code)))
    body = F.substring(found, F.lit(2), F.length(found) - 2)
    code = (F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int"))
            .when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body)).cast("int")).otherwise(F.try_element_at(names, body)))

    def character(n: Column) -> Column:
        real = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        spelled = F.decode(F.unhex(F.lpad(F.hex(F.when(real, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(n.isNull(), found).when(n == 0xA0, " ").otherwise(spelled)

    return let(code, character)


def _decoded(text: Column) -> Column:
    """A text with its entities decoded in one pass, so nothing is decoded twice."""
    def walked(t: Column) -> Column:
        parts = F.arrays_zip(F.split(t, ENTITY, -1).alias("gap"), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)).alias("found"))
        named = parts.cast("array<struct<gap: string, found: string>>")
        return F.array_join(F.transform(named, lambda p: F.concat(p["gap"], F.coalesce(_entity(p["found"]), F.lit("")))), "")

    return let(text, lambda t: F.when(t.contains("&"), walked(t)).otherwise(t))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_scripts(body: Column) -> Column:
    """A page's markup without comments, scripts and styles."""
    return F.regexp_replace(body, NOT_TEXT, " ")


def title_in(markup: Column) -> Column:
    """The title of markup ``without_scripts``: the first heading, else the ``<title>``."""
    heading = _one_line(_decoded(F.regexp_replace(F.regexp_extract(markup, H1, 1), r"<[^>]*>", "")))
    title = _one_line(_decoded(F.regexp_extract(markup, TITLE, 1)))
    return F.regexp_extract(F.concat(heading, F.lit("\n"), title), r"([^\n]+)", 1)


def text_in(markup: Column) -> Column:
    """The text of markup ``without_scripts``."""
    part = F.regexp_replace(F.regexp_replace(markup, AROUND_TEXT, " "), ARTICLE, "$1")
    lines = F.regexp_replace(F.regexp_replace(part, BREAKS, "\n"), r"<[^>]*(?:>|\z)", "")
    tidy = F.regexp_replace(F.regexp_replace(_decoded(lines), r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(tidy, r"^\n+|\n+$", ""))


def html_title(body: Column) -> Column:
    """The page's title: its first article heading, else its ``<title>``."""
    return title_in(without_scripts(body))


def markdown_title(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t#]*$", 1))


def main_text(body: Column) -> Column:
    """The text of a page without scripts, navigation, footers and advertisements.

    Where the page marks an article or a main part, that part; else everything left. Native expressions only, tolerant of
    unclosed tags.
    """
    return text_in(without_scripts(body))


# --- attribute values ---------------------------------------------------------------------

_REFERENCE = re.compile(r"&(?:#(?:[xX][0-9A-Fa-f]+|[0-9]+);?|[A-Za-z][A-Za-z0-9]*;?)")
_NAME_GOES_ON = re.compile(r"[=A-Za-z0-9]")


def unescape_attribute(value: str) -> str:
    """An attribute value as a browser reads it.

    Numeric references always count, closed names when they are known; a name without its semicolon counts only when
    neither ``=`` nor an ASCII letter or digit follows, so ``?id=1&copy=2`` keeps its parameter.
    """
    def decoded(match: re.Match) -> str:
        found = match.group()
        if found[1] == "#":
            return html.unescape(found if found.endswith(";") else found + ";")
        if found.endswith(";"):
            return html5.get(found[1:], found)
        follows = value[match.end():match.end() + 1]
        return found if _NAME_GOES_ON.match(follows) else html5.get(found[1:], found)

    return _REFERENCE.sub(decoded, value)


@F.pandas_udf(StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unescape_attribute(v))


def html_unescape_attr(href: Column) -> Column:
    """Attribute decoding. Only a value that holds ``&`` carries anything to the Arrow UDF."""
    return F.when(href.contains("&"), _unescaped(F.when(href.contains("&"), href))).otherwise(href)


# --- Markdown -----------------------------------------------------------------------------

# Blanks, line ends and tabs that stay as they are while everything else is tidied; no page's text holds these characters.
_BLANK, _LINE, _TAB = "\x01", "\x02", "\x03"
_KEPT = str.maketrans({" ": _BLANK, "\n": _LINE, "\t": _TAB})
_FORBIDDEN = str.maketrans("", "", _BLANK + _LINE + _TAB)
# A quoted value ends where markup begins again, so a lost quotation mark costs its own tag and no more.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+)>|<[^>]*(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([A-Za-z][A-Za-z0-9:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
_BLOCKS = frozenset("p div section article main blockquote header figure dl dt dd body".split())


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, quoted either way or not at all; of one named twice the first."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


class _Folded:
    """One pass over a page's tags, with the elements that are open."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.inline: list[tuple[str, str]] = []  # open emphasis and links, and what closes them
        self.lists: list[list] = []  # open lists: the next number or None, and how far their items' text stands in
        self.tables: list[list[int | bool]] = []  # open tables: rows so far, cells of this row, whether a row and whether a cell is open
        self.code = False
        self.item = False  # nothing has come since an item's mark
        self.next = ""  # what comes before the next text or mark of an item that goes on below something else

    def text(self, text: str) -> None:
        if self.code:
            self.out.append(text.translate(_KEPT))
        elif self.tables:
            if self.tables[-1][3]:
                self.out.append(text.replace("\n", " ").replace("|", "\\|"))
        else:
            if text.strip():
                self.go_on()
            self.item = self.item and not text.strip()
            if not (self.item and text.isspace()):
                self.out.append(text)

    def go_on(self) -> None:
        if self.next:
            self.out.append(self.next)
            self.next = ""

    def close_inline(self, down_to: int = 0) -> None:
        while len(self.inline) > down_to:
            blank = []  # emphasis ends before blanks, or it is none
            while self.out and self.out[-1].isspace():
                blank.append(self.out.pop())
            held = self.out[-1].rstrip() if self.out else ""
            self.out[-1:] = [held, self.inline.pop()[1], (self.out[-1][len(held):] if self.out else "") + "".join(reversed(blank))]

    def block(self) -> None:
        self.close_inline()
        if self.tables and self.tables[-1][3]:
            self.out.append(" ")
        elif not self.item:
            self.out.append("\n\n")
            self.next = _BLANK * self.lists[-1][1] if self.lists else ""

    def end_row(self, table: list) -> None:
        if table[2]:
            self.close_inline()
            self.out.append(" |" + ("\n|" + " --- |" * table[1] if table[0] == 0 else ""))
            table[0] += 1
            table[1:] = [0, False, False]

    def tag(self, closing: bool, name: str, rest: str) -> None:
        if self.code and name != "pre":
            return
        if name == "pre":
            self.close_inline()
            if closing and self.code:
                while self.out[-1].endswith(_LINE):
                    self.out[-1] = self.out[-1][:-1]
                self.out.append("\n```\n\n")
            elif not closing and not self.code:
                self.out.append("\n\n```\n")
            self.code, self.item = not closing, False
        elif name in _EMPHASIS or name == "a":
            self._inline(closing, name, rest)
        elif name in ("ul", "ol"):
            self._list(closing, name, rest)
        elif name == "li":
            self.close_inline()
            if not closing:
                number, _ = at = self.lists[-1] if self.lists else [None, 2]
                before = self.lists[-2][1] if len(self.lists) > 1 else 0
                mark = "- " if number is None else f"{number}. "
                at[:] = [number if number is None else number + 1, before + len(mark)]
                self.out.append("\n" + _BLANK * before + mark)
                self.item, self.next = True, ""
        elif name in ("table", "tr", "td", "th"):
            self._table(closing, name)
        elif name == "img" and not closing:
            found = attributes(rest)
            if found.get("src"):
                self.go_on()
                self.out.append(f"![{found.get('alt', '')}]({_address(found['src'])})")
                self.item = False
        elif name == "br":
            self.out.append(" " if self.tables else "\n")
        elif name == "hr":
            self.block()
            self.out.append("---\n\n")
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            self.block()
            if not closing:
                self.out.append("#" * int(name[1]) + " ")
        elif name in _BLOCKS:
            self.block()

    def _inline(self, closing: bool, name: str, rest: str) -> None:
        names = [n for n, _ in self.inline]
        if closing:
            if name in names:
                self.close_inline(len(names) - 1 - names[::-1].index(name))
            return
        href = attributes(rest).get("href") if name == "a" else None
        if name in _EMPHASIS or href:
            self.go_on()
            self.inline.append((name, _EMPHASIS.get(name) or f"]({_address(href)})"))
            self.out.append(_EMPHASIS.get(name, "["))
            self.item = False

    def _list(self, closing: bool, name: str, rest: str) -> None:
        self.close_inline()
        if closing:
            if self.lists:
                self.lists.pop()
            self.next = "\n" + _BLANK * self.lists[-1][1] if self.lists else ""
            if not self.lists:
                self.out.append("\n\n")
        else:
            self.next = ""
            if not self.lists:
                self.out.append("\n\n")
            start = attributes(rest).get("start", "1")
            inside = self.lists[-1][1] if self.lists else 0
            self.lists.append([int(start) if start.isdigit() else 1, inside] if name == "ol" else [None, inside])
        self.item = False

    def _table(self, closing: bool, name: str) -> None:
        if name == "table" and not closing:
            self.block()
            self.tables.append([0, 0, False, False])
        if not self.tables:
            return
        table = self.tables[-1]
        if name in ("table", "tr") and (closing or name == "tr"):
            self.end_row(table)
        if name == "table" and closing:
            self.tables.pop()
            self.out.append("\n\n")
        elif name in ("td", "th"):
            self.close_inline()
            table[3] = not closing
            if not closing:
                self.out.append(" | " if table[2] else "\n| ")
                table[1:3] = [table[1] + 1, True]
        self.item = False


def _address(url: str) -> str:
    return url.strip().replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def folded(markup: str) -> str:
    """Markup as Markdown, entities and blanks still as they were; what must stay blank is marked."""
    fold, at = _Folded(), 0
    markup = markup.translate(_FORBIDDEN)
    for found in _TAG.finditer(markup):
        if found.start() > at:
            fold.text(markup[at:found.start()])
        at = found.end()
        if found[2]:
            fold.tag(found[1] == "/", found[2].lower(), found[3])
            if found[2].lower() == "pre" and not found[1] and markup[at:at + 1] == "\n":
                at += 1
    if at < len(markup):
        fold.text(markup[at:])
    if fold.code:
        fold.tag(True, "pre", "")
    for table in reversed(fold.tables):
        fold.end_row(table)
    fold.close_inline()
    return "".join(fold.out)


@F.pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else folded(v))


TIDY = [(r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]


def html_to_markdown(body: Column) -> Column:
    """Article HTML as Markdown: headings, paragraphs, links, images, nested and numbered lists, code, tables.

    The part that ``main_text`` takes. A line break in the markup stays one, which Markdown reads as a blank. Code keeps its blanks and line ends. What is open where
    a block ends ends with it. Tags are folded by an Arrow UDF that keeps the open elements on a stack, a thing no expression here can say; before and after it all is native.
    """
    part = F.regexp_replace(F.regexp_replace(without_scripts(body), AROUND_TEXT, " "), ARTICLE, "$1")

    def tidied(text: Column) -> Column:
        for pattern, to in TIDY:
            text = F.regexp_replace(text, pattern, to)
        return F.translate(text, _BLANK + _LINE + _TAB, " \n\t")

    return let(_decoded(_folded(part)), tidied)
