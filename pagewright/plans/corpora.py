"""Inputs derived from the driver's tables.

The tables hold ordinary pages and plain conversations. What the operators also have to handle (refusals, bot checks,
misread bodies, retries; tool results, child sessions, saved files) is laid over every row by its id, so the inputs grow
with the tables and no row is left out. The oracle SQL lays the same over the same rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import site_of
from pagewright.operators.links import extract_links, resolve_links
from pagewright.operators.ordered import salted_join
from pagewright.plans.layout import spread
from pagewright.sources.pages import scan_pages

SHELL = "<html><head><title>shell</title></head><body><div id=root></div></body></html>"
CHALLENGE = '<div id="challenge-running"></div>'
FAKE_PDF = "<!doctype html><html><body>not a document</body></html>"

ATTEMPT = ("struct<attempt_no:int,via:string,status:int,content_type:string,kind:string,text:string,body_b64:string,"
           "ext:string,error:string,threw:boolean>")


def _attempt(no: int, via: str, status: int, content_type: str | None, kind: str, text: Column | None = None,
             body_b64: Column | None = None, ext: str | None = None, error: str | None = None, threw: bool = False) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(no).alias("attempt_no"), F.lit(via).alias("via"), F.lit(status).alias("status"),
                    F.lit(content_type).cast("string").alias("content_type"), F.lit(kind).alias("kind"),
                    (none if text is None else text).alias("text"),
                    (none if body_b64 is None else body_b64).alias("body_b64"), F.lit(ext).cast("string").alias("ext"),
                    F.lit(error).cast("string").alias("error"), F.lit(threw).alias("threw"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(scan_pages(spark, sf_dir), "page_id")


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log over every page: ordinary answers, and by page id every kind of trouble an answer can be."""
    html, id_ = F.col("html"), F.col("page_id")
    fetched = lambda ct, text, status=200, no=1, via="fetch": _attempt(no, via, status, ct, "text", text)
    failed = lambda error, no=1, via="fetch", threw=False: _attempt(no, via, 0, None, "error", error=error, threw=threw)
    document = lambda text: _attempt(1, "fetch", 200, "application/pdf", "file", body_b64=F.base64(text.cast("binary")), ext="pdf")
    page = fetched("text/html; charset=utf-8", html)
    tab = fetched("text/html", html, no=2, via="tab")
    detached = "CDP session detached: target closed"
    misread = fetched("text/html", F.replace(html, F.lit("e"), F.lit("�")))
    trouble = {  # by page_id % 32
        0: [fetched("text/html", F.concat(html, F.lit(CHALLENGE)))],
        1: [fetched("text/html", html, status=403)],
        2: [fetched("text/html; charset=iso-8859-1", F.replace(html, F.lit("a"), F.lit("�")))],
        3: [misread, failed(detached, no=2, via="tab")],
        19: [misread, failed(detached, no=2, via="tab"), fetched("text/html", html, no=3, via="tab")],
        4: [fetched("application/json", F.concat(F.lit('{"id": '), id_.cast("string"), F.lit("}")))],
        5: [fetched("application/json", html)],
        6: [fetched("text/markdown; charset=utf-8", F.concat(F.lit("# Page "), id_.cast("string"), F.lit("\n\nbody words\n")))],
        7: [fetched("text/plain", F.lit("  \n"))],
        8: [failed("timeout"), fetched("text/html", html, no=2)],
        24: [failed("timeout")],
        9: [failed("fetch failed", threw=True), tab],
        25: [failed("fetch failed", threw=True), failed("net::ERR_NAME_NOT_RESOLVED", no=2, via="tab")],
        10: [fetched("text/html", F.lit(SHELL)), fetched("text/html", F.lit(SHELL), no=2, via="tab")],
        26: [fetched("text/html", F.lit(SHELL))],
        11: [document(F.concat(F.lit("%PDF-1.7 "), id_.cast("string")))],
        12: [document(F.lit(FAKE_PDF))],
        13: [failed("fetch failed", threw=True)],
        14: [fetched("application/rss+xml", F.lit('<?xml version="1.0" encoding="euc-kr"?><rss>�</rss>'))],
    }
    kind = F.pmod(id_, F.lit(32))
    attempts = F.array(page)
    for code, made in trouble.items():
        attempts = F.when(kind == code, F.array(*made)).otherwise(attempts)
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    return (pages.select("page_id", "url", F.col("url").alias("final_url"), F.explode(attempts).alias("a"))
            .select("page_id", "url", "final_url", "a.*"))


# The same log for the oracle. ``att`` has one row per attempt.
FETCH_LOG_SQL = f"""
base AS (SELECT page_id, url, html, page_id % 32 AS k FROM pages),
att AS (
  SELECT page_id, url, 1 AS attempt_no, 'fetch' AS via,
    CASE WHEN k = 1 THEN 403 WHEN k IN (8, 24, 9, 25, 13) THEN 0 ELSE 200 END AS http_status,
    CASE WHEN k IN (0, 1, 3, 19, 10, 26) THEN 'text/html' WHEN k = 2 THEN 'text/html; charset=iso-8859-1'
         WHEN k IN (4, 5) THEN 'application/json' WHEN k = 6 THEN 'text/markdown; charset=utf-8' WHEN k = 7 THEN 'text/plain'
         WHEN k IN (8, 24, 9, 25, 13) THEN NULL WHEN k IN (11, 12) THEN 'application/pdf' WHEN k = 14 THEN 'application/rss+xml'
         ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN k IN (8, 24, 9, 25, 13) THEN 'error' WHEN k IN (11, 12) THEN 'file' ELSE 'text' END AS kind,
    CASE WHEN k = 0 THEN html || '{CHALLENGE}' WHEN k = 2 THEN replace(html, 'a', chr(65533))
         WHEN k IN (3, 19) THEN replace(html, 'e', chr(65533)) WHEN k = 4 THEN '{{"id": ' || page_id || '}}'
         WHEN k = 6 THEN '# Page ' || page_id || chr(10) || chr(10) || 'body words' || chr(10)
         WHEN k = 7 THEN '  ' || chr(10) WHEN k IN (8, 24, 9, 25, 13, 11, 12) THEN NULL WHEN k IN (10, 26) THEN '{SHELL}'
         WHEN k = 14 THEN '<?xml version="1.0" encoding="euc-kr"?><rss>' || chr(65533) || '</rss>' ELSE html END AS text,
    CASE WHEN k IN (8, 24) THEN 'timeout' WHEN k IN (9, 25, 13) THEN 'fetch failed' END AS error,
    k IN (9, 25, 13) AS threw, k
  FROM base
  UNION ALL
  SELECT page_id, url, 2, CASE WHEN k = 8 THEN 'fetch' ELSE 'tab' END,
    CASE WHEN k IN (3, 19, 25) THEN 0 ELSE 200 END, CASE WHEN k IN (3, 19, 25) THEN NULL ELSE 'text/html' END,
    CASE WHEN k IN (3, 19, 25) THEN 'error' ELSE 'text' END,
    CASE WHEN k IN (3, 19, 25) THEN NULL WHEN k = 10 THEN '{SHELL}' ELSE html END,
    CASE WHEN k IN (3, 19) THEN 'CDP session detached: target closed' WHEN k = 25 THEN 'net::ERR_NAME_NOT_RESOLVED' END,
    false, k
  FROM base WHERE k IN (3, 19, 8, 9, 25, 10)
  UNION ALL
  SELECT page_id, url, 3, 'tab', 200, 'text/html', 'text', html, NULL, false, k FROM base WHERE k = 19
)"""


def site_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root a site: the site's first page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return (pages.groupBy(site_of(F.col("url")).alias("site")).agg(F.min_by("url", "page_id").alias("root"))
            .select("root"))


def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page. The corpus links only to pages it does not hold, so each page also links, first of all, to the
    site's page with the next id."""
    from pyspark.sql import Window
    rows = pages(spark, sf_dir)
    links = resolve_links(extract_links(rows)).select("src", (F.col("pos") + 1).alias("pos"), "dst")
    order = Window.partitionBy(site_of(F.col("url")), F.floor(F.col("page_id") / 4096)).orderBy("page_id")
    chain = rows.select(F.col("url").alias("src"), F.lit(0).alias("pos"), F.lead("url").over(order).alias("dst"))
    return links.unionByName(chain)


def sitemap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(root, ord, url)``: what every site's sitemap lists: its pages under both names, one relative entry and one page
    elsewhere."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    roots = site_roots(spark, sf_dir).select(site_of(F.col("root")).alias("site"), "root")
    listed = pages.withColumn("site", site_of(F.col("url")))
    rows = salted_join(listed, roots, ["site"], F.col("page_id")).select("root", F.explode(F.array(
        F.struct((F.col("page_id") * 4).alias("ord"), F.col("url").alias("url")),
        F.struct((F.col("page_id") * 4 + 1).alias("ord"),
                 F.regexp_replace("url", r"^(https?)://(www\.)?", "$1://www.").alias("url")),
        F.struct((F.col("page_id") * 4 + 2).alias("ord"), F.lit("/relative").alias("url")),
        F.struct((F.col("page_id") * 4 + 3).alias("ord"),
                 F.concat(F.lit("https://elsewhere.test/"), F.pmod("page_id", F.lit(7)).cast("string")).alias("url")))).alias("r"))
    return rows.select("root", "r.*")


# --- transcripts --------------------------------------------------------------------------
#
# Every conversation is a session. A user row opens a turn, and the assistant's row after it is worked out as a search, a
# fetch, a child's task, a download and the answer; what varies, varies by conversation and turn. Child sessions hold one
# task per assistant row and are reused by later turns.

BASE_MS = 1_700_000_000_000
#: Rows of conversations that one task makes records of, some ten a row.
TASK_TURNS = 4096
_NONE = {"event": "STRING", "content": "ARRAY<STRUCT<type: STRING, text: STRING, name: STRING, arguments: STRUCT<url: STRING, objective: STRING, description: STRING>>>",
         "stopReason": "STRING", "errorMessage": "STRING", "toolName": "STRING",
         "details": "STRUCT<sources: ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, excerpt: STRING>>, taskId: STRING>", "isError": "BOOLEAN",
         "usage": "STRUCT<input: BIGINT, output: BIGINT, cacheRead: BIGINT, cacheWrite: BIGINT, reasoning: BIGINT, totalTokens: BIGINT, cost: STRUCT<total: DOUBLE>>",
         "timing": "STRUCT<durationMs: DOUBLE>"}


# The records as SQL text: one parse instead of a call for each part of a long expression.
def _record(ts: str, role: str, **fields: str) -> str:
    made = ", ".join(f"'{name}', CAST({fields.get(name, 'NULL')} AS {kind})" for name, kind in _NONE.items())
    return f"named_struct('role', '{role}', {made}, 'timestamp', {ts})"


def _say(text: str) -> str:
    return f"array(named_struct('type', 'text', 'text', {text}, 'name', NULL, 'arguments', NULL))"


def _call(*calls: tuple[str, str, str]) -> str:
    def block(name: str, key: str, value: str) -> str:
        args = ", ".join(f"'{k}', {value if k == key else 'NULL'}" for k in ("url", "objective", "description"))
        return f"named_struct('type', 'toolCall', 'text', NULL, 'name', '{name}', 'arguments', named_struct({args}))"

    return f"array({', '.join(block(*c) for c in calls)})"


def _found(*sources: tuple[str, str, str, str]) -> str:
    rows = ", ".join(f"named_struct('id', {i}, 'url', {u}, 'title', {t}, 'excerpt', {x})" for i, u, t, x in sources)
    return f"named_struct('sources', array({rows}), 'taskId', NULL)"


def _spent(n: str) -> str:
    return (f"named_struct('input', {n}, 'output', 0, 'cacheRead', 0, 'cacheWrite', 0, 'reasoning', 0, 'totalTokens', {n}, "
            f"'cost', named_struct('total', {n} / 1024D))")


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp column in microseconds since 1970, read as UTC whatever the session's time zone is."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def run_id(conv: Column, turn: Column) -> Column:
    return F.concat(F.lit("240101-"), F.lpad(turn.cast("string"), 6, "0"), F.lit("-"), conv.cast("string"), F.lit("-ask"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, index, raw)``: transcript records of every conversation, its child sessions included."""
    rows = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", TASK_TURNS).selectExpr(
        "conv_id", "turn", "role", "text", "CAST(conv_id AS STRING) AS c", "CAST(turn AS STRING) AS t", "concat('P', conv_id) AS parent",
        "concat('K', conv_id, 'x', turn DIV 4) AS child", f"{BASE_MS} + conv_id * 10000000 + turn * 100000 AS t0",
        "conv_id % 4 <> 0 AS framed", "conv_id % 5 = 0 AND turn % 4 = 3 AS left_open", "(conv_id + turn) % 6 = 0 AS kid_open",
        "(conv_id + turn) % 11 = 0 AS broke", "conv_id % 7 = 0 AS refused", "CAST(length(text) AS BIGINT) AS n")
    at = lambda slot: f"t0 + {slot * 1000}"
    site = lambda k: f"concat('https://e.test/', c, '/{k}')"
    sid = lambda k: f"concat('s', c, 'x', t, '{k}')"
    tag = lambda k: f"concat('<webfetch-citation source_id=\"', {k}, '\" />')"
    after_tag = "IF(refused, '\\nHTTP 403 Forbidden\\nAccess denied', concat('\\n\\n', text))"
    saved = "concat('/home/u/sessions/2024-01-01_', parent, '/tmp/doc', turn DIV 2, '.pdf')"
    notice = f"concat({tag(sid('d'))}, '\\n\\nDownloaded to: ', {saved}, '\\nMIME type: application/pdf\\nFile size: ', n % 3, ' bytes')"
    answer = (f"concat('Seen <citation refs=\"', {sid('a')}, ',', {sid('b')}, '\">both</citation> and <quote ref=\"none\">this</quote>: ', "
              "text, ' [file](artifacts/f', t, '.pdf)')")
    prompt = "concat(text, '\\n\\n(run-marker:240101-', lpad(t, 6, '0'), '-', c, '-ask — ignore this line)')"
    own = lambda slot, record, keep="true": f"named_struct('keep', {keep}, 'session_id', parent, 'index', turn * 10 + {slot}, 'r', {record})"
    kid = lambda slot, record, keep="true": f"named_struct('keep', {keep}, 'session_id', child, 'index', turn * 10 + {slot}, 'r', {record})"
    tool = lambda slot, name, content, details="NULL": _record(
        at(slot), "toolResult", toolName=f"'{name}'", content=_say(content), isError="false", details=details,
        timing=f"named_struct('durationMs', CAST((conv_id + turn + {slot}) % 50 AS DOUBLE))")
    searched = _found((sid("a"), site("a"), "'A'", "text"), (sid("b"), site("b"), "''", "''"),
                      (sid("c"), "concat('https://e.test/', c, '/c', t)", "'C'", "''"))
    docs = "concat('https://docs.test/', c)"
    last = _record(at(8), "assistant", content=_say(f"IF(broke, '', {answer})"), stopReason="IF(broke, 'error', 'stop')",
                   errorMessage="IF(broke, 'usage limit', NULL)", usage=_spent("n"))
    user = [own(0, _record(at(0), "turn-lifecycle", event="'started'"), "framed"), own(1, _record(at(1), "user", content=_say(prompt)))]
    system = [own(0, _record(at(0), "system-message", content=_say("text")))]
    assistant = [
        own(0, _record(at(0), "assistant", stopReason="'toolUse'", usage=_spent("100L"),
                       content=_call(("websearch", "objective", "text"), ("webfetch", "url", site("b")), ("webfetch", "url", docs)))),
        own(1, tool(1, "websearch", "'results'", searched)),
        own(2, tool(2, "webfetch", f"concat({tag(sid('b'))}, {after_tag})", _found((sid("b"), site("b"), "'B'", "''")))),
        own(3, tool(3, "webfetch", notice, _found((sid("d"), docs, "'D'", "''")))),
        own(4, tool(4, "subagent", "'spawned'", "named_struct('sources', NULL, 'taskId', child)")),
        own(7, _record(at(7), "turn-lifecycle", event="'final-started'"), "framed AND NOT left_open"),
        own(8, last, "NOT left_open"),
        own(9, _record(at(9), "turn-lifecycle", event="'finished'"), "framed AND NOT left_open"),
        kid(0, _record("t0 + 4001", "turn-lifecycle", event="'started'"), "framed"),
        kid(1, _record("t0 + 4002", "user", content=_say("concat('task ', t)"))),
        kid(2, _record("t0 + 4003", "assistant", stopReason="'toolUse'", usage=_spent("10L"), content=_call(("webfetch", "url", site("a"))))),
        kid(3, tool(5, "webfetch", f"concat({tag(chr(39) + 'k' + chr(39))}, '\\n\\n', text)",
                    _found((f"concat('k', {sid('')})", site("a"), "'A'", "''")))),
        kid(4, _record(at(6), "assistant", content=_say("concat('child did ', t)"), stopReason="'stop'", usage=_spent("1L")), "NOT kid_open"),
        kid(5, _record("t0 + 6001", "turn-lifecycle", event="'finished'"), "framed AND NOT kid_open")]
    made = (f"CASE WHEN role = 'user' THEN array({', '.join(user)}) WHEN role = 'assistant' THEN array({', '.join(assistant)}) "
            f"ELSE array({', '.join(system)}) END")
    return (rows.selectExpr(f"explode({made}) AS e").filter("e.keep")
            .selectExpr("e.session_id", "e.index", "to_json(e.r) AS raw"))


NOW_MS = BASE_MS + 500_000_000


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every prompt, and for every conversation one whose turn never appeared."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    conv, turn = F.col("conv_id"), F.col("turn")
    group = F.concat(F.lit("g"), F.floor(conv / 3).cast("string"))
    v = F.pmod(conv * 7 + turn, F.lit(13))
    text = F.lit(None).cast("string")
    asked = rows.filter("role = 'user'").select(
        run_id(conv, turn).alias("run_id"), group.alias("group"), (F.lit(BASE_MS) + conv * 10_000_000 + turn * 100_000 - 500).alias("created_at"),
        F.lit(True).alias("supervised"), (v != 3).alias("alive"), F.when(v == 1, 1).when(v == 2, 143).alias("exit_code"),
        (v == 2).alias("ended_by_supervisor"), F.when(v == 0, "failed").alias("recorded"), F.when(v == 0, "recorded before").alias("reason"))
    lost = rows.select("conv_id").distinct().select(
        F.concat(F.lit("240102-000000-"), conv.cast("string"), F.lit("-lost")).alias("run_id"), group.alias("group"),
        (F.lit(BASE_MS) + conv * 10_000_000).alias("created_at"), (F.pmod(conv, F.lit(3)) != 0).alias("supervised"), F.lit(True).alias("alive"),
        F.when(F.pmod(conv, F.lit(3)) == 1, 0).alias("exit_code"), F.lit(False).alias("ended_by_supervisor"), text.alias("recorded"),
        text.alias("reason"))
    return asked.unionByName(lost)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, rel_path, path, mtime)``: a file per answer, some written over in a later turn, and one older file."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'").select("conv_id", "turn")
    conv, turn = F.col("conv_id"), F.col("turn")
    at = F.lit(BASE_MS) + conv * 10_000_000 + turn * 100_000 + 5000
    session = F.concat(F.lit("P"), conv.cast("string"))
    rel = F.concat(F.lit("f"), turn.cast("string"), F.lit(".pdf"))
    later = F.when(F.pmod(conv + turn, F.lit(5)) == 0, 250_000).when(F.pmod(conv + turn, F.lit(5)) == 1, -250_000).otherwise(0)
    files = rows.select(session.alias("session_id"), rel.alias("rel_path"), (at + later).alias("mtime"))
    old = rows.select("conv_id").distinct().select(session.alias("session_id"), F.lit("old.pdf").alias("rel_path"),
                                                   (F.lit(BASE_MS) + conv * 10_000_000 - 1).alias("mtime"))
    both = files.unionByName(old)
    return both.withColumn("path", F.concat(F.lit("/home/u/sessions/2024-01-01_"), "session_id", F.lit("/artifacts/"), "rel_path"))


# The same events for the oracle, typed, straight from the conversations: no JSON is read.
def _event(session: str, slot: int, kind: str, ts: str, where: str, lifecycle: str = "''", stop: str = "''", error: str = "''",
           content: str = "''", tool: str = "''", child: str = "NULL", tokens: str = "NULL", duration: str = "NULL") -> str:
    return (f"SELECT conv, turn, {session} AS session_id, turn * 10 + {slot} AS idx, '{kind}' AS kind, {lifecycle} AS lifecycle, "
            f"{stop} AS stop, {error} AS error, {content} AS content, {tool} AS tool_name, {ts} AS ts, {child} AS child, "
            f"{tokens} AS tokens, {duration} AS duration FROM c WHERE {where}")


_A, _DUR = "role = 'assistant'", "(conv + turn + {}) % 50"
_TAG_B = "'<webfetch-citation source_id=\"s' || conv || 'x' || turn || 'b\" />'"
_TAG_D = "'<webfetch-citation source_id=\"s' || conv || 'x' || turn || 'd\" />'"
_SAVED = "'/home/u/sessions/2024-01-01_' || parent || '/tmp/doc' || (turn // 2) || '.pdf'"
_NL = "chr(10)"
ANSWER_SQL = ("'Seen <citation refs=\"s' || conv || 'x' || turn || 'a,s' || conv || 'x' || turn || 'b\">both</citation> and "
              "<quote ref=\"none\">this</quote>: ' || text || ' [file](artifacts/f' || turn || '.pdf)'")
EVENTS_SQL = f"""
c AS (
  SELECT conv_id AS conv, turn, role, text, 'P' || conv_id AS parent, 'K' || conv_id || 'x' || (turn // 4) AS kid, conv_id % 4 <> 0 AS framed,
    conv_id % 5 = 0 AND turn % 4 = 3 AS left_open, (conv_id + turn) % 6 = 0 AS kid_open, (conv_id + turn) % 11 = 0 AS broke,
    conv_id % 7 = 0 AS refused, {BASE_MS} + conv_id * 10000000 + turn * 100000 AS t0 FROM conversations),
ev AS (
  {_event("parent", 0, "lifecycle", "t0", "role = 'user' AND framed", lifecycle="'started'")}
  UNION ALL {_event("parent", 1, "user", "t0 + 1000", "role = 'user'", content="text || chr(10) || chr(10) || '(run-marker:240101-' || lpad(turn::VARCHAR, 6, '0') || '-' || conv || '-ask — ignore this line)'")}
  UNION ALL {_event("parent", 0, "system", "t0", "role = 'system'", content="text")}
  UNION ALL {_event("parent", 0, "assistant", "t0", _A, stop="'tool'", tokens="100")}
  UNION ALL {_event("parent", 1, "tool_result", "t0 + 1000", _A, content="'results'", tool="'websearch'", duration=_DUR.format(1))}
  UNION ALL {_event("parent", 2, "tool_result", "t0 + 2000", _A, tool="'webfetch'", duration=_DUR.format(2), content=f"{_TAG_B} || CASE WHEN refused THEN {_NL} || 'HTTP 403 Forbidden' || {_NL} || 'Access denied' ELSE {_NL} || {_NL} || text END")}
  UNION ALL {_event("parent", 3, "tool_result", "t0 + 3000", _A, tool="'webfetch'", duration=_DUR.format(3), content=f"{_TAG_D} || {_NL} || {_NL} || 'Downloaded to: ' || {_SAVED} || {_NL} || 'MIME type: application/pdf' || {_NL} || 'File size: ' || (length(text) % 3) || ' bytes'")}
  UNION ALL {_event("parent", 4, "tool_result", "t0 + 4000", _A, content="'spawned'", tool="'subagent'", child="kid", duration=_DUR.format(4))}
  UNION ALL {_event("parent", 7, "lifecycle", "t0 + 7000", f"{_A} AND framed AND NOT left_open", lifecycle="'final-started'")}
  UNION ALL {_event("parent", 8, "assistant", "t0 + 8000", f"{_A} AND NOT left_open", stop="CASE WHEN broke THEN 'error' ELSE 'end' END", error="CASE WHEN broke THEN 'usage limit' ELSE '' END", content=f"CASE WHEN broke THEN '' ELSE {ANSWER_SQL} END", tokens="length(text)")}
  UNION ALL {_event("parent", 9, "lifecycle", "t0 + 9000", f"{_A} AND framed AND NOT left_open", lifecycle="'finished'")}
  UNION ALL {_event("kid", 0, "lifecycle", "t0 + 4001", f"{_A} AND framed", lifecycle="'started'")}
  UNION ALL {_event("kid", 1, "user", "t0 + 4002", _A, content="'task ' || turn")}
  UNION ALL {_event("kid", 2, "assistant", "t0 + 4003", _A, stop="'tool'", tokens="10")}
  UNION ALL {_event("kid", 3, "tool_result", "t0 + 5000", _A, tool="'webfetch'", duration=_DUR.format(5), content=f"'<webfetch-citation source_id=\"k\" />' || {_NL} || {_NL} || text")}
  UNION ALL {_event("kid", 4, "assistant", "t0 + 6000", f"{_A} AND NOT kid_open", stop="'end'", content="'child did ' || turn", tokens="1")}
  UNION ALL {_event("kid", 5, "lifecycle", "t0 + 6001", f"{_A} AND framed AND NOT kid_open", lifecycle="'finished'")}),
src AS (
  SELECT parent AS session_id, turn * 10 + 1 AS idx, 0 AS pos, 's' || conv || 'x' || turn || 'a' AS id, 'https://e.test/' || conv || '/a' AS url,
    'A' AS title, text AS excerpt, false AS opened, false AS holds_page, '' AS saved_path FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10 + 1, 1, 's' || conv || 'x' || turn || 'b', 'https://e.test/' || conv || '/b', '', '', false, false, '' FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10 + 1, 2, 's' || conv || 'x' || turn || 'c', 'https://e.test/' || conv || '/c' || turn, 'C', '', false, false, '' FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10 + 2, 0, 's' || conv || 'x' || turn || 'b', 'https://e.test/' || conv || '/b', 'B', '', NOT refused, NOT refused, '' FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10 + 3, 0, 's' || conv || 'x' || turn || 'd', 'https://docs.test/' || conv, 'D', '', true, false,
    CASE WHEN length(text) % 3 = 0 THEN '' ELSE {_SAVED} END FROM c WHERE {_A}
  UNION ALL SELECT kid, turn * 10 + 3, 0, 'ks' || conv || 'x' || turn, 'https://e.test/' || conv || '/a', 'A', '', true, true, '' FROM c WHERE {_A}),
calls AS (
  SELECT parent AS session_id, turn * 10 AS idx, 0 AS pos, 'websearch' AS name, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS target FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10, 1, 'webfetch', 'e.test' FROM c WHERE {_A}
  UNION ALL SELECT parent, turn * 10, 2, 'webfetch', 'docs.test' FROM c WHERE {_A}
  UNION ALL SELECT kid, turn * 10 + 2, 0, 'webfetch', 'e.test' FROM c WHERE {_A}),
tn AS (
  SELECT ev.*, sum(CASE WHEN lifecycle = 'started' OR (kind = 'user' AND conv % 4 = 0) THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY idx)::BIGINT AS turn_no FROM ev),
turns AS (
  SELECT session_id, turn_no, min(idx) AS start_index, min(ts) AS start_ts, max(ts) AS last_ts, min(idx) FILTER (kind = 'user') AS prompt_index,
    min(idx) FILTER (lifecycle = 'finished') AS finished_index, max(idx) FILTER (kind = 'assistant' AND stop = 'end') AS last_end_index,
    arg_max(lifecycle, idx) FILTER (lifecycle <> '') AS phase,
    arg_max(CASE WHEN kind = 'assistant' THEN stop ELSE '' END, idx) FILTER (kind IN ('user', 'assistant', 'tool_result')) AS spoken
  FROM tn GROUP BY session_id, turn_no),
judged AS (
  SELECT *, CASE WHEN phase IS NOT NULL THEN phase = 'finished' ELSE coalesce(spoken IN ('end', 'error'), false) END AS finished,
    coalesce(spoken = 'error', false) AS failed FROM turns),
prompts AS (
  SELECT j.session_id, j.turn_no, j.prompt_index, e.content AS prompt, regexp_extract(e.content, '\\(run-marker:([^\\s)]+)', 1) AS run_id
  FROM judged j JOIN ev e ON e.session_id = j.session_id AND e.idx = j.prompt_index),
rt AS (
  SELECT p.run_id, j.*, n.start_ts AS next_ts FROM prompts p JOIN judged j USING (session_id, turn_no, prompt_index)
  LEFT JOIN judged n ON n.session_id = j.session_id AND n.turn_no = j.turn_no + 1 WHERE p.run_id <> ''),
own AS (
  SELECT rt.run_id, e.*, -1 AS stream, '' AS child_id FROM rt JOIN tn e USING (session_id, turn_no)
  WHERE e.idx >= rt.prompt_index AND (rt.finished_index IS NULL OR e.idx <= rt.finished_index)),
named AS (SELECT run_id, child AS child_id, min(idx) AS mention FROM own WHERE child IS NOT NULL GROUP BY run_id, child),
given AS (
  SELECT n.run_id, n.child_id, n.mention, k.turn_no FROM named n JOIN rt USING (run_id)
  JOIN judged k ON k.session_id = n.child_id AND k.turn_no > 0 AND k.start_ts >= rt.start_ts AND (rt.next_ts IS NULL OR k.start_ts < rt.next_ts)),
tasks AS (SELECT *, turn_no = max(turn_no) OVER (PARTITION BY run_id, child_id) AS last_task FROM given),
kids AS (
  SELECT t.run_id, e.*, t.mention AS stream, t.child_id FROM tasks t JOIN judged j ON j.session_id = t.child_id AND j.turn_no = t.turn_no
  JOIN tn e ON e.session_id = t.child_id AND e.turn_no = t.turn_no WHERE e.idx >= j.prompt_index),
scoped AS (SELECT * FROM own UNION ALL SELECT * FROM kids),
ssrc AS (
  SELECT s.run_id, s.stream, s.child_id, s.ts, s.tool_name, s.content, x.* FROM scoped s JOIN src x ON x.session_id = s.session_id AND x.idx = s.idx),
runs AS (
  SELECT '240101-' || lpad(turn::VARCHAR, 6, '0') || '-' || conv || '-ask' AS run_id, 'g' || (conv // 3) AS grp, t0 - 500 AS created_at,
    true AS supervised, (conv * 7 + turn) % 13 <> 3 AS alive, CASE (conv * 7 + turn) % 13 WHEN 1 THEN 1 WHEN 2 THEN 143 END AS exit_code,
    (conv * 7 + turn) % 13 = 2 AS ended_by_supervisor, CASE WHEN (conv * 7 + turn) % 13 = 0 THEN 'failed' END AS recorded,
    CASE WHEN (conv * 7 + turn) % 13 = 0 THEN 'recorded before' END AS reason FROM c WHERE role = 'user'
  UNION ALL
  SELECT DISTINCT '240102-000000-' || conv || '-lost', 'g' || (conv // 3), {BASE_MS} + conv * 10000000, conv % 3 <> 0, true,
    CASE WHEN conv % 3 = 1 THEN 0 END, false, NULL, NULL FROM c),
art AS (
  SELECT parent AS session_id, 'f' || turn || '.pdf' AS rel_path,
    t0 + 5000 + CASE (conv + turn) % 5 WHEN 0 THEN 250000 WHEN 1 THEN -250000 ELSE 0 END AS mtime FROM c WHERE {_A}
  UNION ALL SELECT DISTINCT parent, 'old.pdf', {BASE_MS} + conv * 10000000 - 1 FROM c WHERE {_A}),
art_turn AS (
  SELECT a.*, coalesce((SELECT max(turn_no) FROM judged j WHERE j.session_id = a.session_id AND j.turn_no > 0 AND j.start_ts <= a.mtime), 0) AS turn_no
  FROM art a)"""
