"""Pages against plain models: bodies made from the dimensions of each rule."""
from __future__ import annotations

import base64
import itertools
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewright.functions import body_kind, frontmatter, html_title, html_to_markdown, main_text, not_utf8, preview, run_label, url_slug, word_count
from pagewright.functions.markup import folded
from pagewright.operators import pages
from pagewright.sources.pages import UNREADABLE, batch_trailers, scan_fetch_log

RESPONSE = "url string, status int, content_type string, kind string, text string, body_b64 string, ext string, error string, threw boolean, via string, attempt_no int"
LOST = "�"


def prose(n: int) -> str:
    return "<html><head><title>t</title></head><body><article>" + "<p>" + " ".join(f"w{i}" for i in range(n)) + "</p></article></body></html>"


# --- status ---


def plain_status(r: dict) -> str:
    if r["kind"] == "error":
        return "error"
    if r["status"] >= 400:
        return "blocked"
    html = r["content_type"] == "text/html"
    if html and r["bot"]:
        return "challenge"
    if r["misread"]:
        return "shell" if html else "unsupported"
    if not html and not r["n"]:
        return "error"
    if html and r["n"] < 80:
        return "shell_escalated" if r["via"] == "tab" else "shell"
    return "ok"


def test_statuses_over_all_facts(table) -> None:
    rows = []
    for kind, status, ct, bot, misread, n, via in itertools.product(("text", "error"), (200, 404), ("text/html", "application/json", "text/markdown"), (False, True), (False, True), (0, 79, 80), ("fetch", "tab")):
        words = " ".join(f"w{i}" for i in range(n))
        body = f"<body><article>{words}</article>{'<i id=\"challenge-running\"></i>' if bot else ''}" if ct == "text/html" else words
        charset = "; charset=koi8-r" if misread and ct != "text/markdown" else ""
        wrong = bool(charset)
        rows.append({"url": f"https://s.test/{len(rows)}", "kind": kind, "status": status, "content_type": ct + charset, "text": body + (LOST if wrong and n else "") if kind == "text" else None, "via": via,
                     "error": "went wrong" if kind == "error" else None, "plain": {"kind": kind, "status": status, "content_type": ct, "bot": bot, "misread": wrong and n > 0, "n": n, "via": via}})
    got = {r.url: r for r in pages.page_status(table(RESPONSE, rows)).collect()}
    for r in rows:
        assert got[r["url"]].status == plain_status(r["plain"]), r
        assert got[r["url"]].savable == (got[r["url"]].status == "ok")
    asked = {r.url: r for r in pages.save_as_html(table(RESPONSE, rows)).collect()}
    for r in rows:
        p = r["plain"]
        assert asked[r["url"]].savable == (p["kind"] != "error" and p["status"] < 400 and p["content_type"] == "text/html" and not p["bot"] and not p["misread"])


def test_extensions_and_document_verdicts(table) -> None:
    kinds = {"text/html": ".md", "text/markdown": ".md", "text/plain": ".md", "application/ld+json": ".json", "application/x-ndjson": ".jsonl", "image/svg+xml": ".xml", "application/rss+xml": ".xml"}
    rows = [{"url": ct, "kind": "text", "status": 200, "content_type": ct, "text": prose(90) if "html" in ct else "some words"} for ct in kinds]
    assert {r.url: r.ext for r in pages.page_status(table(RESPONSE, rows)).collect()} == kinds
    files = table("url string, status int, kind string, content_type string, doc_status string, doc_error string", [("a", 200, "file", "application/pdf", "needs_ocr", "no text layer"), ("b", 200, "file", "application/pdf", None, None)])
    assert {r.url: (r.status, r.error) for r in pages.page_status(files).collect()} == {"a": ("needs_ocr", "no text layer"), "b": ("ok", None)}


def test_html_served_as_data_is_seen_behind_any_noise(table) -> None:
    noises = ["", "﻿", "<!-- a -->\n<!-- b -->", "<?xml version=\"1.0\"?>\n", "\n \t", "<!--x-->" * 700]
    starts = ["<!DOCTYPE html>", "<html lang=\"x\">", "<HEAD>", "<body\n>", "<meta charset=\"a\">"]
    data = ['{"html": 1}', "<rss><html/></rss>", "<htmlish>", "text <html>", "<svg><head/></svg>"]
    rows = [(str(i), ct, n + s, hit) for i, (ct, n, (s, hit)) in enumerate(itertools.product(("application/json", "text/xml", ""), noises, [(s, True) for s in starts] + [(d, False) for d in data]))]
    got = {r.i: r.k for r in table("i string, ct string, body string, hit boolean", rows).select("i", body_kind(F.col("ct"), F.col("body")).alias("k")).collect()}
    for i, ct, _, hit in rows:
        assert got[i] == ("html" if hit else {"application/json": "json", "text/xml": "xml", "": "text"}[ct])


def test_charsets_by_place_name_and_count(table) -> None:
    """Where a charset is named, which, how many characters were lost and how many survived, for pages and for data."""
    places = {"none": ("", ""), "header": ("; charset={}", ""), "meta": ("", "<meta charset='{}'>"), "http-equiv": ("", "<meta http-equiv=content-type content='text/html; charset={}'>"), "script": ("", "<script charset='{}'></script>"),
              "xml": ("", "<?xml version='1.0' encoding='{}'?>")}
    rows = []
    for (place, (header, head)), name, lost, kept, ct in itertools.product(places.items(), ("windows-1251", "UTF8", "unicode-1-1-utf-8"), (0, 1, 19, 20, 40), (0, 30), ("text/html", "application/xml")):
        other = name == "windows-1251" and place not in ("none", "script")
        html = ct == "text/html"
        declared = other and (html or place in ("header", "xml"))
        body = (head.format(name) if place == "xml" else f"<p>{head.format(name)}</p>") + LOST * lost + "ж" * kept
        rows.append((len(rows), ct + header.format(name), body, "html" if html else "xml", bool(lost) and (declared or html and lost >= 20 and lost > kept)))
    frame = table("i int, ct string, body string, kind string, want boolean", rows)
    got = {r.i: r.bad for r in frame.select("i", not_utf8(F.col("body"), F.col("ct"), F.col("kind")).alias("bad")).collect()}
    assert [got[r[0]] for r in rows] == [r[4] for r in rows]


def test_documents_by_their_bytes(table) -> None:
    ole, sign = bytes.fromhex("D0CF11E0A1B11AE1"), b"HWP Document File"
    at = lambda *places: ole + b"".join(b"\0" * (p - q) + sign for p, q in zip(places, [8, *(x + len(sign) for x in places)], strict=False))
    comments = b"<!-- c -->\n" * 600
    cases = {"p": ("pdf", b"%PDF-1.4 x", "pdf", "ok"), "fake": ("pdf", b"<html>", "html", "unsupported"), "far": ("csv", comments + b"<!doctype html><p>", "html", "unsupported"), "csv": ("csv", b"a,b\n1,2", "csv", "ok"),
             "zip": ("docx", b"PK\3\4rest", "docx", "ok"), "bare": ("", b"PK\3\4rest", "zip", "unsupported"), "hwpx": ("zip", b"PK\3\4" + b"\0" * 26 + b"mimetypeapplication/hwp+zip", "hwpx", "ok"), "xls": ("xls", ole, "xls", "ok"),
             "hwp": ("hwp", at(512), "hwp", "ok"), "off": ("hwp", at(500), "ole", "unsupported"), "second": ("hwp", at(500, 640), "hwp", "ok"), "none": ("pdf", b"", None, "unsupported")}
    rows = [{"url": k, "kind": "file", "status": 200, "ext": ext, "body_b64": base64.b64encode(body).decode()} for k, (ext, body, _, _) in cases.items()] + [{"url": "torn", "kind": "file", "status": 200, "ext": "pdf", "body_b64": "%%%"}]
    got = {r.url: (r.real_ext, r.doc_status) for r in pages.doc_triage(table(RESPONSE, rows)).collect()}
    assert got.pop("torn") == (None, "error")
    assert {k: v for k, v in got.items() if k != "none"} == {k: v[2:] for k, v in cases.items() if k != "none"} and got["none"][1] == "unsupported"


# --- text ---


def test_titles_and_text(table) -> None:
    bodies = {
        "article": ("<title>A &amp; B</title><nav>menu</nav><article><h1>Caf&eacute; <i>&#8217;s</i>&nbsp;x&hellip;</h1><p>One<br>two</p><ul><li>a</li></ul></article><footer>f", "Café ’s x…", "Café ’s x…\nOne\ntwo\na"),
        "plain": ("<head><title> T\n1 </title></head>body &lt;b&gt; &amp;amp; &unknown; &#x1F600; &#0;", "T 1", "body <b> &amp; &unknown; 😀 �"),
        "script": ("<p>x<script>var a='<p>no</p>'</script><style>p{}</style><!-- no --></p>", "", "x"),
        "empty": ("", "", ""),
    }
    rows = table("k string, b string", [(k, v[0]) for k, v in bodies.items()])
    got = {r.k: (r.t, r.m) for r in rows.select("k", html_title(F.col("b")).alias("t"), main_text(F.col("b")).alias("m")).collect()}
    assert got == {k: v[1:] for k, v in bodies.items()}


def test_markdown_keeps_structure(table) -> None:
    body = ('<nav>menu</nav><article><h2>Head &amp; <b>tail</b></h2><p>See <a href="https://x.test/?a=1&amp;b=2">the <em>link</em></a> and <code>x</code>.</p><ul><li>one</li><li>two</li></ul>'
            '<pre>code\nlines</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><hr><img alt="pic" src="/p.png"></article>')
    got = table("b string", [(body,)]).select(html_to_markdown(F.col("b")).alias("m")).first().m
    assert got.split("\n\n") == ["## Head & **tail**", "See [the *link*](https://x.test/?a=1&b=2) and `x`.", "- one\n- two", "```\ncode\nlines\n```", "| k | v |\n| --- | --- |\n| 1 | 2 |", "---", "![pic](/p.png)"]


def test_markdown_of_every_quoting_nesting_and_what_is_never_closed(table) -> None:
    bodies = {
        "<p>a <b class=x>bold</b> <a href='/q?a=1'>s</a> <a href=/bare>b</a> <a name=z>no link</a></p>": "a **bold** [s](/q?a=1) [b](/bare) no link",
        "<ol><li>one<li>two<ul><li>in</li></ul><li>three</ol><p>after": "1. one\n2. two\n   - in\n3. three\n\nafter",
        "<ul><li>a<ol start='3'><li>x</li><li>y</li></ol></li></ul>": "- a\n  3. x\n  4. y",
        "<pre>\n  two  blanks\n\tand a tab\n</pre>x": "```\n  two  blanks\n\tand a tab\n```\n\nx",
        "<pre><code>a &lt; b\n\n\n\nc</code></pre>": "```\na < b\n\n\n\nc\n```",
        "<table><tr><td>a<td>b<tr><td>c<br>d<td></table>": "| a | b |\n| --- | --- |\n| c d | |",
        "<p>un<b>closed<p>next</i> </b>": "un**closed**\n\nnext",
        "<p>a<img src='x y.png'><img alt=none></p><hr><h3>T</h3>t": "a![](x%20y.png)\n\n---\n\n### T\n\nt",
        '<p title="a > b">kept</p><a href="/x" title="lost>text</a> more': "kept\n\ntext more",
        "<pre>never closed\n  x": "```\nnever closed\n  x\n```",
        "": "",
    }
    rows = table("b string", [(b,) for b in bodies])
    got = {r.b: r.m for r in rows.select("b", html_to_markdown(F.col("b")).alias("m")).collect()}
    assert got == bodies
    assert table("b string", [(None,)]).select(html_to_markdown(F.col("b")).alias("m")).first().m is None


def test_markdown_lists_and_tables_equal_a_tree_written_plainly() -> None:
    """Random trees: the markup is written with any quoting and without some end tags, the Markdown straight from the tree."""
    rng = random.Random(4)

    def lists(depth: int, at: int) -> tuple[str, list[str]]:
        ordered, first = rng.random() < 0.5, rng.randint(1, 12)
        html_, lines = "", []
        for i in range(rng.randint(1, 3)):
            mark = f"{first + i}. " if ordered else "- "
            inner, below = lists(depth + 1, at + len(mark)) if depth < 3 and rng.random() < 0.4 else ("", [])
            html_ += f"<li>w{i}{inner}" + rng.choice(["</li>", ""])
            lines += [" " * at + mark + f"w{i}", *below]
        name = "ol" if ordered else "ul"
        start = rng.choice([f" start={first}", f" start='{first}'", f' class="a" start="{first}"']) if ordered else ""
        return f"<{name}{start}>{html_}</{name}>", lines
    for _ in range(150):
        html_, lines = lists(0, 0)
        text = re.sub("[\x01\x02\x03]", lambda m: {"\x01": " ", "\x02": "\n", "\x03": "\t"}[m.group()], folded(html_))
        assert [line for line in text.split("\n") if line.strip()] == lines
        rows = [[f"c{rng.randint(0, 9)}" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        cell = rng.choice(["td", "th"])
        html_ = "<table>" + "".join("<tr>" + "".join(f"<{cell} x='1'>{c}" + rng.choice([f"</{cell}>", ""]) for c in row) + rng.choice(["</tr>\n", ""]) for row in rows) + "</table>"
        want = ["| " + " | ".join(row) + " |" for row in rows]
        want.insert(1, "|" + " --- |" * len(rows[0]))
        assert [line for line in folded(html_).split("\n") if line.strip()] == want


def test_words_labels_names(table) -> None:
    rng = random.Random(3)
    texts = ["".join(rng.choice(["abc", " ", "\n", "가", "漢字", "é", "-", "1"]) for _ in range(40)) for _ in range(60)] + ["", None]
    cjk = re.compile("[ᄀ-ᇿ぀-鿿가-힯豈-﫿]")
    rows = table("i int, t string", list(enumerate(texts)))
    for r in rows.select("i", word_count(F.col("t")).alias("n"), run_label(F.col("t")).alias("label"), preview(F.col("t"), 10).alias("p")).collect():
        t = texts[r.i] or ""
        assert r.n == len(cjk.sub(" ", t).split()) + (len(cjk.findall(t)) + 1) // 2
        if texts[r.i] is not None:
            words = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t))
            assert r.label == ("-".join(words[:4]) or "run")
            assert (r.p.content, r.p.truncated) == (t[:10], len(t) > 10)
    urls = ["https://www.h.test/a b/ü?q=1#f", "http://h.test:81//", "https://h.test/" + "x" * 300]
    slugs = [r.s for r in table("u string", [(u,) for u in urls]).select(url_slug(F.col("u")).alias("s")).collect()]
    assert slugs[0] == "www.h.test-a-b-ü.md" and slugs[1] == "h.test.md" and len(slugs[2]) == 123
    header = table("u string, t string", [("https://h.test/", 'say "hi"\n')]).select(frontmatter(F.col("u"), F.col("t"), F.lit("tab")).alias("h")).first().h
    assert [json.loads(line.split(": ", 1)[1]) for line in header.split("\n")[1:3]] == ["https://h.test/", 'say "hi"\n'] and header.endswith("via: tab\n---\n\n")


def test_files_keep_apart_and_are_numbered(table) -> None:
    urls = ["https://h.test/a/b", "https://h.test/a-b", "https://h.test/a?b", "https://h.test/c"]
    named = {r.url: r.file for r in pages.unique_slug(table("url string", [(u,) for u in urls])).collect()}
    assert len(set(named.values())) == 4 and named[min(urls[:2])] == "h.test-a-b.md" and named[urls[3]] == "h.test-c.md"
    listing = table("root string, ord bigint, url string", [("r", 10_000 * i, f"u{i}") for i in range(12)] + [(None, 5, "x"), (None, 1, "y"), ("q", None, "z")])
    got = {(r.root, r.url): r.number for r in pages.crawl_number(listing, ["root"]).collect()}
    assert got == {**{("r", f"u{i}"): f"{i:03d}-" for i in range(12)}, (None, "y"): "000-", (None, "x"): "001-", ("q", "z"): "000-"}


def test_globs(table) -> None:
    urls = table("url string", [(u,) for u in ("https://www.g.test/docs/a", "https://g.test/docs/b?x", "https://g.test/blog/docs", "http://g.test/docs/c")])
    kept = lambda **o: sorted(r.url for r in pages.glob_filter(urls, **o).collect())
    assert kept(include=["https://www.g.test/docs/*"]) == ["https://g.test/docs/b?x", "https://www.g.test/docs/a"]
    assert kept(include=["*/docs/?"], exclude=["http://*"]) == ["https://www.g.test/docs/a"]
    assert len(kept(exclude=["*blog*"])) == 3


# --- logs ---


def test_no_line_of_a_fetch_log_vanishes(spark, tmp_path) -> None:
    lines = ['{"url": "a", "kind": "text", "text": "x\\u2028y"}', "{ torn", '{"kind": "batch_done", "requested": 2, "hit_budget": true}', '{"url": "b", "kind": "error", "error": "e\u0085f"}', "words"]
    (tmp_path / "log.json").write_text("\n".join(lines) + "\n")
    got = [(r.url, r.kind, r.error, r.unreadable) for r in scan_fetch_log(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("a", "text", None, None), ("b", "error", "e\u0085f", None), (None, "error", UNREADABLE, "{ torn"), (None, "error", UNREADABLE, "words")], key=str)
    assert [(r.requested, r.hit_budget) for r in batch_trailers(spark, str(tmp_path)).collect()] == [(2, True)]


@pytest.mark.parametrize("keys", [None, ["host"]])
def test_status_counts(table, keys) -> None:
    rows = table("host string, status string", [("h", "ok"), ("h", "ok"), ("g", "ok"), ("g", "shell")])
    got = {tuple(r)[:-1]: r.n for r in pages.status_counts(rows, keys).collect()}
    assert got == ({("ok",): 3, ("shell",): 1} if keys is None else {("h", "ok"): 2, ("g", "ok"): 1, ("g", "shell"): 1})
