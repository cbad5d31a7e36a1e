"""SQL text for the oracles: the column functions written once more, in DuckDB's SQL."""
from __future__ import annotations

import re

from pagewright.functions import bodies, markup, text, urls
from pagewright.operators import links, pages


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def one_of(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rep(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def ext(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, {group})"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def decoded(expr: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expr = f"replace({expr}, {lit(entity)}, {lit(char)})"
    return expr


def article_of(expr: str) -> str:
    kept = rep(rep(expr, markup.NOT_TEXT, " "), markup.AROUND_TEXT, " ")
    article = ext(kept, r'(?is)<(?:article|main)\b[^>]*>(.*?)(?:</(?:article|main)\s*>|\z)')
    return f"CASE WHEN {has(article, r'\S')} THEN {article} ELSE {kept} END"


def main_text(expr: str) -> str:
    lines = rep(f"regexp_replace({article_of(expr)}, {lit(markup.BREAKS)}, chr(10), 'g')", r"<[^>]*(?:>|\z)")
    tidy = f"regexp_replace({rep(decoded(lines), r'[ \t\r\f]+', ' ')}, {lit(r' ?\n[ \n]*')}, chr(10), 'g')"
    return f"trim({rep(tidy, r'^\n+|\n+$')}, ' ')"


def html_to_markdown(expr: str) -> str:
    """Markdown of pages whose articles hold headings, paragraphs, breaks, links and emphasis that is closed by the next paragraph."""
    text = article_of(expr)
    for pattern, to in ((r"(?is)<b>(([^<]|<br>)*?)((?:<br>|\s)*(?:</?(?:p|h1|div)[^>]*>|\z))", r"**\1**\3"), (r"(?i)<h1[^>]*>", "\n\n# "), (r"(?i)<br>", "\n"), (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"),
                        (r"(?i)<ul>|</ul>", "\n\n"), (r"(?i)<li>", "\n- "), (r"(?i)</?(p|div|h1)( [^>]*)?>", "\n\n"), (r"<[^>]*(>|$)", "")):
        text = rep(text, pattern, to)
    text = decoded(text)
    for pattern, to in ((r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n\n+", "\n\n"), (r"^[\n ]+|[\n ]+$", "")):
        text = rep(text, pattern, to)
    return text


def one_line(expr: str) -> str:
    return f"trim({rep(expr, r'\s+', ' ')}, ' ')"


def html_title(expr: str) -> str:
    body = rep(expr, markup.NOT_TEXT, " ")
    heading = one_line(decoded(rep(ext(body, markup.H1), "<[^>]*>")))
    title = one_line(decoded(ext(body, markup.TITLE)))
    return f"CASE WHEN {heading} <> '' THEN {heading} ELSE {title} END"


def words(expr: str) -> str:
    return (f"(len(regexp_extract_all({expr}, {lit(rf'[^\s{text.CJK}]+')})) "
            f"+ (length({rep(expr, rf'[^{text.CJK}]+')}) + 1) // 2)::BIGINT")


def body_kind(ct: str, body: str) -> str:
    media = f"trim(lower(split_part(coalesce({ct}, ''), ';', 1)))"
    claimed = (f"CASE WHEN {media} IN {one_of(bodies.HTML_TYPES)} THEN 'html' WHEN {media} IN {one_of(bodies.MARKDOWN_TYPES)} "
               f"THEN 'markdown' WHEN {media} IN {one_of(bodies.JSONL_TYPES)} THEN 'jsonl' WHEN {media} IN {one_of(bodies.JSON_TYPES)} "
               f"OR {media} LIKE '%+json' THEN 'json' WHEN {media} IN {one_of(bodies.XML_TYPES)} OR {media} LIKE '%+xml' THEN 'xml' "
               f"WHEN {media} LIKE 'text/%' OR {media} = '' THEN 'text' ELSE 'file' END")
    sniff = has(f"coalesce({body}, '')", r"(?is)^(?:\x{FEFF}|\s|<!--.*?-->|<\?xml.*?\?>)*<(?:!doctype\s+html|html|head|body|meta)[\s>/]")
    return f"CASE WHEN ({claimed} IN ('json', 'jsonl', 'xml') OR {media} = '') AND {sniff} THEN 'html' ELSE {claimed} END"


def _other(charset: str) -> str:
    return f"({charset} <> '' AND {charset} NOT IN {one_of(bodies.UTF8_NAMES)})"


def not_utf8(body: str, ct: str, kind: str) -> str:
    n = f"(length({body}) - length(replace({body}, chr(65533), '')))"
    header = _other(f"lower({ext(f'coalesce({ct}, {lit('')})', '(?i)charset\\s*=\\s*[\"\']?([^\\s;\"\']+)')})")
    meta = _other(f"lower({ext(body, '(?i)<meta\\b[^>]*\\bcharset\\s*=\\s*[\"\']?\\s*([^\\s\"\'/>;]+)')})")
    xml = _other(f"lower({ext(body, '(?i)^[\\s\\x{FEFF}]*<\\?xml[^>]*\\bencoding\\s*=\\s*[\"\']([^\"\']+)')})")
    left = f"length({rep(body, r'[\x00-\x7F\x{FFFD}]+')})"
    return (f"CASE WHEN coalesce({n}, 0) = 0 THEN false WHEN {kind} = 'html' THEN (({header} OR {xml} OR {meta}) AND {n} >= 1) "
            f"OR ({n} >= {bodies.MANY_REPLACED} AND {n} > {left}) ELSE {header} OR {xml} END")


def is_challenge(body: str) -> str:
    return has(f"coalesce({body}, '')", bodies.CHALLENGE_PATTERN)


JUDGED_SQL = f"""
facts AS (
  SELECT *, CASE WHEN kind = 'text' THEN {body_kind('content_type', 'text')} ELSE kind END AS body_kind FROM att),
seen AS (
  SELECT *, body_kind = 'html' AND {is_challenge('text')} AS challenge,
         kind = 'text' AND {not_utf8('text', 'content_type', 'body_kind')} AS misread FROM facts),
main AS (
  SELECT *, CASE WHEN body_kind = 'html' AND kind = 'text' AND http_status < 400 AND NOT challenge AND NOT misread
                 THEN {main_text('text')} WHEN body_kind IN ('markdown', 'text') THEN text END AS content FROM seen),
counted AS (
  SELECT *, CASE WHEN content IS NULL THEN 0 ELSE {words('content')} END AS words FROM main),
jud AS (
  SELECT page_id, url, attempt_no, via, k, http_status, kind, threw, body_kind, words, challenge, misread,
    CASE WHEN kind = 'error' THEN 'error' WHEN http_status >= 400 THEN 'blocked' WHEN challenge THEN 'challenge'
         WHEN kind = 'file' THEN 'ok' WHEN misread THEN CASE WHEN body_kind = 'html' THEN 'shell' ELSE 'unsupported' END
         WHEN body_kind = 'file' THEN 'unsupported' WHEN body_kind <> 'html' AND NOT {has("coalesce(text, '')", r'\S')} THEN 'error'
         WHEN body_kind = 'html' AND words < {pages.MIN_WORDS} THEN CASE WHEN via = 'tab' THEN 'shell_escalated' ELSE 'shell' END
         ELSE 'ok' END AS status,
    CASE WHEN kind = 'error' THEN error WHEN http_status >= 400 THEN 'HTTP ' || http_status
         WHEN challenge THEN 'a bot check answered instead of the page' WHEN kind = 'file' THEN NULL
         WHEN misread THEN '{pages.NOT_UTF8}' WHEN body_kind = 'file' THEN 'not a text this can read'
         WHEN body_kind <> 'html' AND NOT {has("coalesce(text, '')", r'\S')} THEN 'the response is empty'
         WHEN body_kind = 'html' AND words < {pages.MIN_WORDS} THEN 'only ' || words || ' words extracted' END AS error,
    CASE WHEN kind = 'text' AND body_kind = 'html' AND NOT challenge AND NOT misread AND http_status < 400 THEN {html_title('text')}
         WHEN body_kind = 'markdown' THEN trim({ext('text', r'(?m)^#[ \t]+(.+?)[ \t#]*$')}) ELSE '' END AS title
  FROM counted)"""


def url_part(url: str, group: int) -> str:
    return ext(url, urls.URL, group)


def host(url: str) -> str:
    authority = f"lower({rep(url_part(url, 2), '^.*@')})"
    return rep(authority, ":[0-9]*$")


def site_of(url: str) -> str:
    """Only for URLs without a port of their own, as in the tables."""
    return f"(lower({url_part(url, 1)}) || '://' || {rep(host(url), r'^www\.')})"


def url_key(url: str) -> str:
    path = url_part(url, 3)
    return f"({site_of(url)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {url_part(url, 4)})"


def slug(url: str) -> str:
    joined = rep(rep(f"({host(url)} || '-' || {url_part(url, 3)})", r"[^\p{L}\p{N}._-]+", "-"), "-{2,}", "-")
    return f"({rep(f'left({joined}, {urls.SLUG_CHARS})', '^-+|-+$')} || '.md')"


def json_string(expr: str) -> str:
    return f"to_json(coalesce({expr}, ''))::VARCHAR"


LINKS_SQL = f"""
hrefs AS (
  SELECT page_id, url, unnest(h) AS raw, generate_subscripts(h, 1) - 1 AS pos FROM (
    SELECT page_id, url, regexp_extract_all({rep('html', markup.NOT_TEXT, ' ')}, {lit(links.HREF)}, 1) AS h FROM pages)),
links AS (
  SELECT page_id, url, pos, {rep('raw', "^[\"']|[\"']$")} AS href FROM hrefs),
resolved AS (
  SELECT url AS src, pos, {ext('url', r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)')} || {rep("replace(href, '&amp;', '&')", '#.*$')} AS dst
  FROM links)"""

SITES_SQL = f"""
sites AS (SELECT page_id, url, {site_of('url')} AS site FROM pages),
roots AS (SELECT site, arg_min(url, page_id) AS root FROM sites GROUP BY site),
edges AS (
  SELECT src, pos + 1 AS pos, dst FROM resolved
  UNION ALL
  SELECT url, 0, lead(url) OVER (PARTITION BY site, page_id // 4096 ORDER BY page_id) FROM sites)"""

SITEMAP_SQL = f"""
listed AS (
  SELECT root, page_id * 4 AS ord, s.url FROM sites s JOIN roots USING (site)
  UNION ALL
  SELECT root, page_id * 4 + 1, {rep('s.url', r'^(https?)://(www\.)?', '\\1://www.')} FROM sites s JOIN roots USING (site)
  UNION ALL
  SELECT root, page_id * 4 + 2, '/relative' FROM sites s JOIN roots USING (site)
  UNION ALL
  SELECT root, page_id * 4 + 3, 'https://elsewhere.test/' || (page_id % 7) FROM sites s JOIN roots USING (site))"""


def sortable(n: str) -> str:
    return f"(lpad(length(({n})::VARCHAR)::VARCHAR, 2, '0') || ({n})::VARCHAR)"


def walk_sql(depth: int) -> str:
    """The walk by enumeration of paths. The first level of a page is the shortest path to it, its way the least one."""
    return f"""
linked AS (
  SELECT {url_key('src')} AS src_key, dst, min(pos) AS pos FROM edges GROUP BY 1, 2),
paths(root, key, url, way, depth) AS (
  SELECT root, {url_key('root')}, root, '', 0 FROM roots
  UNION ALL
  SELECT p.root, {url_key('l.dst')}, l.dst, p.way || {sortable('l.pos')}, p.depth + 1
  FROM paths p JOIN linked l ON l.src_key = p.key
  WHERE p.depth < {depth} AND l.dst IS NOT NULL AND {site_of('l.dst')} = {site_of('p.root')}),
walk AS (
  SELECT root, key, min(depth) AS depth, min({sortable('depth')} || way) AS ord,
         arg_min(url, {sortable('depth')} || way) AS url FROM paths GROUP BY root, key),
walked AS (
  SELECT w.*, CASE WHEN w.depth < {depth} THEN w.key IN (SELECT src_key FROM linked) END AS read FROM walk w)"""
