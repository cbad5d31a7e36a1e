"""Queries over transcripts: events, turns, runs, evidence, answers, verdicts."""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import answers, audit, events, evidence, logs, reports, states, turns
from pagewright.plans import corpora
from pagewright.plans.layout import dealt, spread
from pagewright.plans.registry import query
from pagewright.plans.scratch import scratch, write_files
from pagewright.session import stored
from pagewright.sources import transcripts

E = f"WITH {corpora.EVENTS_SQL}"


#: Columns of events that turns, runs, their children and answers are made of.
TURNED = ("session_id", "index", "kind", "lifecycle", "stop", "content", "ts", "child_ids")


@dataclass
class Store:
    """The transcript store of one query: events typed and written once, with their turns; every branch reads the columns it needs.

    ``also`` names what a query reads of events beside ``TURNED``; nothing else is worked out or written then. None is all.
    """
    spark: SparkSession
    sf_dir: str
    also: tuple[str, ...] | None = None

    @cached_property
    def raw(self) -> DataFrame:
        return corpora.transcripts(self.spark, self.sf_dir)

    @cached_property
    def typed(self) -> DataFrame:
        return events.normalize_events(self.raw)

    @cached_property
    def events(self) -> DataFrame:
        # turns are numbered from a narrow reading of the records, written since numbering reads it twice; events are then written once, each with its turn, and every branch
        # reads the columns it needs
        kinds = stored(self.typed.select("session_id", "index", "kind", "lifecycle"), "kinds")
        counted = stored(turns.segment_turns(kinds).select("session_id", "index", "turn_no"), "turn-numbers")
        typed = self.typed if self.also is None else self.typed.select(*TURNED, *self.also)
        return stored(dealt(typed, ["session_id", "index"], counted.count()).join(counted.hint("merge"), ["session_id", "index"]), "events")

    @cached_property
    def turns(self) -> DataFrame:
        return stored(turns.turns_of(self.events), "turns")

    @cached_property
    def prompts(self) -> DataFrame:
        return turns.prompts_of(self.events, self.turns)

    @cached_property
    def runs(self) -> DataFrame:
        return corpora.runs(self.spark, self.sf_dir)

    @cached_property
    def run_turns(self) -> DataFrame:
        return stored(turns.run_turns(turns.run_session_join(self.runs, self.prompts), self.turns), "run-turns")

    @cached_property
    def own(self) -> DataFrame:
        return turns.run_scope(self.run_turns, self.events)

    @cached_property
    def named(self) -> DataFrame:
        return stored(turns.named_children(self.own), "named")

    @cached_property
    def tasks(self) -> DataFrame:
        return stored(turns.child_tasks(self.run_turns, self.named, self.turns), "tasks")

    @cached_property
    def children(self) -> DataFrame:
        return turns.child_scope(self.tasks, self.events, self.turns)

    @cached_property
    def scoped(self) -> DataFrame:
        return turns.whole_scope(self.own, self.children)

    @cached_property
    def answers(self) -> DataFrame:
        return evidence.final_answer(self.run_turns, self.events)

    @cached_property
    def orphans(self) -> DataFrame:
        return turns.orphan_children(self.named, self.tasks, self.turns)


def _md5(column: str) -> Column:
    return F.md5(column).alias(column)


# --- records ------------------------------------------------------------------------------


@query("scan_transcripts", f"{E} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS index, kind FROM ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "sessions")
    raw = corpora.transcripts(spark, d)
    # one file a session, named for it, written by the task that holds the session's rows in order; 256 folders, so that listing them takes no call a session
    write_files(raw.repartition("session_id").sortWithinPartitions("session_id", "index")
                .select(F.concat(F.substring(F.md5("session_id"), 1, 2), F.lit("/"), "session_id", F.lit(".jsonl")).alias("file"), F.concat("raw", F.lit("\n")).alias("value")), folder)
    scanned = transcripts.scan_transcripts(spark, folder)
    return events.normalize_events(scanned).select("session_id", "index", "kind")


@query("scan_stdout_answer", f"""WITH {corpora.EVENTS_SQL} SELECT 'S' || conv || 'x' || turn AS run_id, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ') AS answer,
  CASE WHEN conv % 2 = 0 THEN 'https://e.test/' || conv ELSE '' END AS urls FROM c WHERE role = 'assistant'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'assistant'")
    dimmed = F.concat(F.lit("\x1b[32mwebfetch\x1b[0m(url: \x1b[32m'https://e.test/"), F.col("conv_id").cast("string"),
                      F.lit("'\x1b[39m)\n\n\x1b[2m > page\n\ntext\x1b[0m\n"))
    value = F.concat(F.when(F.pmod("conv_id", F.lit(2)) == 0, dimmed).otherwise(""), F.col("text"), F.lit("\x1b[0m\n"))
    run = F.concat(F.lit("S"), F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string"))
    found = transcripts.stdout_answer(rows.select(run.alias("run_id"), value.alias("value")))
    return found.select("run_id", "answer", F.array_join("urls", " ").alias("urls"))


@query("normalize_events", f"""{E} SELECT session_id, idx AS index, kind, lifecycle, stop, stop IN ('end', 'error') AS stopped, error, md5(content) AS content,
  tool_name, ts, coalesce(child, '') AS child_ids FROM ev""")
def _(spark: SparkSession, d: str) -> DataFrame:
    typed = Store(spark, d).typed
    return typed.select("session_id", "index", "kind", "lifecycle", "stop", "stopped", "error", _md5("content"), "tool_name", "ts",
                        F.array_join("child_ids", " ").alias("child_ids"))


@query("flatten_content", f"{E} SELECT session_id, idx AS index, md5(content) AS content FROM ev WHERE kind = 'tool_result'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = Store(spark, d).raw.withColumn("_r", F.try_parse_json("raw")).filter(F.try_variant_get("_r", "$.role", "string") == "toolResult")
    content = events.flatten_content(F.try_variant_get("_r", "$.content", "variant"))
    return rows.select("session_id", "index", F.md5(content).alias("content"))


@query("unknown_blocks", """SELECT conv_id, turn, (2 - turn % 2)::INTEGER AS strange FROM conversations""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    block = lambda kind: F.struct(kind.alias("type"), F.col("text").alias("text"))
    blocks = F.array(block(F.lit("text")), block(F.lit("futureAnswer")), block(F.when(F.pmod("turn", F.lit(2)) == 1, "thinking").otherwise("x")))
    content = F.try_parse_json(F.to_json(blocks))
    return rows.select("conv_id", "turn", events.unknown_blocks(content).alias("strange"))


@query("tool_calls", f"{E} SELECT session_id, idx AS index, pos, name, target FROM calls")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.tool_calls(Store(spark, d).typed)


@query("event_sources", f"{E} SELECT session_id, idx AS index, pos, id, url, title, excerpt, opened, holds_page, saved_path FROM src")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.event_sources(Store(spark, d).typed).drop("tool_name", "ts")


@query("http_refusal", f"{E} SELECT session_id, idx AS index, content LIKE '<webfetch%' AND content LIKE '%/>' || chr(10) || 'HTTP 403%' AS refused FROM ev WHERE kind = 'tool_result'")
def _(spark: SparkSession, d: str) -> DataFrame:
    results = Store(spark, d).typed.filter("kind = 'tool_result'")
    return results.select("session_id", "index", events.http_refusal(F.col("content")).alias("refused"))


@query("downloads", f"{E} SELECT session_id, idx AS index, url, saved_path FROM src WHERE saved_path <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.downloads(Store(spark, d).typed).select("session_id", "index", "url", "saved_path")


@query("overflow_pointer", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/s/tmp/result-' || doc_id || '.txt' ELSE '' END AS saved_path FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    file = F.concat(F.lit("/s/tmp/result-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    hint = F.when(F.pmod("doc_id", F.lit(4)) == 0, " — read it with read_file({ path, offset: 1 }), 36.0KB per read.").otherwise("")
    notice = F.concat(F.lit("[Output too large (9.5KB). Full output saved to: "), file, hint, F.lit("]\n\nPreview (first 4.0KB):\n"), F.col("text"))
    text = F.when(F.pmod("doc_id", F.lit(2)) == 0, notice).otherwise(F.col("text"))
    return docs.select("doc_id", events.overflow_pointer(text).alias("saved_path"))


@query("browser_pages", f"""SELECT page_id, pos, u AS url FROM (SELECT page_id, unnest([0, 1]) AS pos, unnest([url, url || '_(x)']) AS u FROM pages)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    printed = F.concat(F.lit('- title: "T" [url='), F.col("url"), F.lit(']\n  It links from this page → Elsewhere (https://e.test/else)\n✔︎ Opened a new tab '
                       "and set it active: tabs[1], page → T ("), F.col("url"), F.lit(")\n✔︎ Opened a new tab, page → B ("), F.col("url"), F.lit("_(x))"))
    record = F.to_json(F.struct(F.lit("toolResult").alias("role"), F.lit("repl").alias("toolName"),
                                F.array(F.struct(F.lit("text").alias("type"), printed.alias("text"))).alias("content")))
    typed = events.normalize_events(pages.select(F.col("page_id").cast("string").alias("session_id"), F.lit(0).alias("index"), record.alias("raw")))
    return events.browser_pages(typed).select(F.col("session_id").cast("long").alias("page_id"), "pos", "url")


@query("usage_rows", f"{E} SELECT session_id, idx AS index, tokens AS input, tokens AS total_tokens, tokens / 1024.0 AS cost FROM ev WHERE kind = 'assistant'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.usage_rows(Store(spark, d).typed).select("session_id", "index", "input", "total_tokens", "cost")


@query("child_ids", f"{E} SELECT session_id, idx AS index, child AS child_id FROM ev WHERE child IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.child_ids(Store(spark, d).typed)


# --- turns and runs -----------------------------------------------------------------------


@query("segment_turns", f"{E} SELECT session_id, idx AS index, turn_no FROM tn")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.segment_turns(Store(spark, d).typed.select("session_id", "index", "kind", "lifecycle")).select("session_id", "index", "turn_no")


@query("turn_finished", f"{E} SELECT session_id, turn_no, finished FROM judged WHERE turn_no > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_finished(Store(spark, d).turns)


@query("session_busy", f"""{E}, l AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) = 1)
SELECT session_id, (turn_no > 0 AND NOT finished) OR length(session_id) % 2 = 0 AS busy,
  CASE WHEN turn_no > 0 AND NOT finished THEN 'a turn is in flight' WHEN length(session_id) % 2 = 0 THEN 'it is still working' ELSE '' END AS reason FROM l""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    status = store.turns.select("session_id", F.when(F.length("session_id") % 2 == 0, "running").otherwise("idle").alias("status"))
    return turns.session_busy(store.turns, status)


@query("sessions_list", f"""{E}, f AS (SELECT session_id, min(prompt_index) AS prompt_index, max(last_ts) AS last_ts FROM judged GROUP BY session_id)
SELECT f.session_id, md5(content) AS prompt, regexp_extract(content, '\\(run-marker:([^\\s)]+)', 1) AS run_id, last_ts
FROM f JOIN ev e ON e.session_id = f.session_id AND e.idx = prompt_index WHERE content LIKE '%run-marker:%' AND content LIKE '%e%'
ORDER BY last_ts DESC, f.session_id LIMIT 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    listed = turns.sessions_list(store.events, store.turns, mine=True, search="e")
    return listed.select("session_id", _md5("prompt"), "run_id", "last_ts")


@query("run_session_join", f"{E} SELECT run_id, grp AS \"group\", session_id, turn_no, prompt_index FROM runs JOIN prompts USING (run_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return turns.run_session_join(store.runs, store.prompts).select("run_id", "group", "session_id", "turn_no", "prompt_index")


@query("run_scope", f"{E} SELECT run_id, session_id, idx AS index, kind FROM own")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).own.select("run_id", "session_id", "index", "kind")


@query("child_scope", f"{E} SELECT run_id, child_id, stream AS mention, idx AS index, turn_no, kind FROM kids")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).children.select("run_id", "child_id", "mention", "index", "turn_no", "kind")


@query("child_tasks", f"{E} SELECT run_id, child_id, mention, turn_no, last_task FROM tasks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).tasks


@query("orphan_children", f"""{E} SELECT n.* FROM named n WHERE NOT EXISTS (SELECT 1 FROM tasks t JOIN judged j ON j.session_id = t.child_id
  AND j.turn_no = t.turn_no WHERE t.run_id = n.run_id AND t.child_id = n.child_id AND t.last_task AND j.finished)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).orphans


REFS = """refs AS (SELECT DISTINCT left(run_id, n) AS ref FROM runs, (SELECT unnest([13, 16, 40]) AS n) UNION SELECT 'nosuch' || grp FROM runs)"""


@query("resolve_run_ref", f"""{E}, {REFS},
m AS (SELECT ref, run_id FROM refs JOIN runs ON starts_with(run_id, ref)),
k AS (SELECT *, count(*) OVER (PARTITION BY ref) AS n, bool_or(run_id = ref) OVER (PARTITION BY ref) AS whole FROM m)
SELECT ref, run_id, CASE WHEN whole THEN 'exact' WHEN n = 1 THEN 'prefix' ELSE 'candidate' END AS verdict, n FROM k WHERE NOT whole OR run_id = ref
QUALIFY row_number() OVER (PARTITION BY ref ORDER BY run_id) <= 10
UNION ALL SELECT ref, NULL, 'unknown', 0 FROM refs WHERE ref NOT IN (SELECT ref FROM m)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = Store(spark, d).runs
    typed = runs.select(F.explode(F.array(F.substring("run_id", 1, 13), F.substring("run_id", 1, 16), F.col("run_id"),
                                          F.concat(F.lit("nosuch"), "group"))).alias("ref"))
    return turns.resolve_run_ref(runs, typed)


@query("recent_runs", f"""{E}, {REFS}, late AS (SELECT run_id, row_number() OVER (ORDER BY created_at DESC, run_id DESC) AS place FROM runs)
SELECT ref, place, run_id FROM late, (SELECT DISTINCT ref FROM refs WHERE NOT EXISTS (SELECT 1 FROM runs WHERE starts_with(run_id, ref))) WHERE place <= 10""")
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = Store(spark, d).runs
    typed = runs.select(F.explode(F.array(F.substring("run_id", 1, 13), F.concat(F.lit("nosuch"), "group"))).alias("ref"))
    return turns.offered_instead(runs, turns.resolve_run_ref(runs, typed))


@query("latest_group", f"{E} SELECT run_id, grp AS \"group\" FROM runs WHERE grp = (SELECT grp FROM runs ORDER BY created_at DESC, grp DESC LIMIT 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.latest_group(Store(spark, d).runs).select("run_id", "group")


@query("artifact_turn", f"{E} SELECT session_id, rel_path, mtime, turn_no FROM art_turn")
def _(spark: SparkSession, d: str) -> DataFrame:
    return turns.artifact_turn(corpora.artifacts(spark, d), Store(spark, d).turns).select("session_id", "rel_path", "mtime", "turn_no")


SAID = """said AS (SELECT rt.run_id, rt.session_id, rt.turn_no, coalesce(e.content, '') AS answer FROM rt
  LEFT JOIN ev e ON e.session_id = rt.session_id AND e.idx = rt.last_end_index AND rt.finished)"""
REFERENCED = f"""{SAID}, names AS (SELECT s.run_id, s.session_id, s.turn_no, a.rel_path, a.turn_no AS wrote FROM said s
  JOIN art_turn a ON a.session_id = s.session_id AND contains(s.answer, '(artifacts/' || a.rel_path || ')'))"""


@query("run_artifacts", f"""{E}, {REFERENCED}
SELECT rt.run_id, a.session_id, a.rel_path, NULL::VARCHAR AS error FROM art_turn a JOIN rt USING (session_id, turn_no)
UNION ALL SELECT run_id, session_id, rel_path, CASE WHEN wrote > turn_no THEN 'changed after a later turn began' END FROM names WHERE wrote <> turn_no""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    files = corpora.artifacts(spark, d)
    said = store.answers.join(store.run_turns.select("run_id", F.col("session_id").alias("author")), "run_id")
    named = answers.referenced_artifacts(said, files)
    return turns.run_artifacts(store.run_turns, turns.artifact_turn(files, store.turns), named).drop("path")


@query("download_owner", f"""{E}, dl AS (SELECT * FROM ssrc WHERE saved_path <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id, saved_path ORDER BY ts DESC, session_id DESC, idx DESC) = 1 AS owns_path FROM dl)
SELECT run_id, session_id, idx AS index, url, saved_path, owns_path,
  owns_path AND row_number() OVER (PARTITION BY run_id, url ORDER BY owns_path DESC, ts DESC, session_id DESC, idx DESC) = 1 AS is_url_file FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    owned = turns.download_owner(events.downloads(Store(spark, d).scoped))
    return owned.select("run_id", "session_id", "index", "url", "saved_path", "owns_path", "is_url_file")


# --- evidence -----------------------------------------------------------------------------


@query("usage_totals", f"""{E} SELECT run_id, sum(tokens)::BIGINT AS input, sum(tokens)::BIGINT AS total_tokens, sum(tokens / 1024.0) AS cost FROM scoped
  WHERE kind = 'assistant' GROUP BY run_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.usage_totals(Store(spark, d).scoped).select("run_id", "input", "total_tokens", "cost")


MERGED = """merged AS (
  SELECT run_id, url, min((stream, child_id, idx, pos)) AS first, bool_or(opened) AS opened,
    coalesce(arg_min(title, (stream, child_id, idx, pos)) FILTER (title <> ''), '') AS title FROM ssrc GROUP BY run_id, url),
numbered AS (SELECT run_id, url, title, opened, row_number() OVER (PARTITION BY run_id ORDER BY first, url) - 1 AS n FROM merged)"""


@query("merge_sources", f"{E}, {MERGED} SELECT run_id, n, url, title, opened FROM numbered")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.merge_sources(Store(spark, d).scoped)


OWNED = """dl AS (SELECT * FROM ssrc WHERE saved_path <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id, saved_path ORDER BY ts DESC, session_id DESC, idx DESC) = 1 AS owns_path FROM dl),
file AS (SELECT run_id, url, saved_path AS file FROM p WHERE owns_path QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY ts DESC, session_id DESC, idx DESC) = 1)"""


@query("source_files", f"{E}, {MERGED}, {OWNED} SELECT run_id, n, url, title, opened, file FROM numbered LEFT JOIN file USING (run_id, url)")
def _(spark: SparkSession, d: str) -> DataFrame:
    # sources and downloads are read off one scope, written without the records' texts
    scoped = stored(Store(spark, d, ("tool_name", "sources")).scoped.select("run_id", "child_id", "stream", "session_id", "turn_no", "index", "ts", "tool_name", "sources"), "scoped")
    return evidence.with_files(evidence.merge_sources(scoped), turns.download_owner(events.downloads(scoped)))


@query("source_ids", f"{E} SELECT DISTINCT run_id, url, id FROM ssrc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_ids(Store(spark, d).scoped)


@query("source_summary", f"{E}, {MERGED} SELECT run_id, count(*) AS sources_total, count(*) FILTER (opened) AS sources_opened FROM numbered GROUP BY run_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_summary(evidence.merge_sources(Store(spark, d).scoped))


@query("source_content", f"""{E},
m AS (SELECT *, regexp_replace(content, '^<[a-z]+-citation [^>]*/>\\n*', '') AS held FROM ssrc),
r AS (SELECT *, CASE WHEN holds_page AND length(regexp_replace(held, '\\s+', '', 'g')) > 0 THEN 3 WHEN excerpt <> '' THEN 2
  WHEN NOT holds_page AND saved_path = '' AND length(regexp_replace(held, '\\s+', '', 'g')) > 0 THEN 1 ELSE 0 END AS rank FROM m)
SELECT run_id, url, rank, md5(CASE rank WHEN 2 THEN excerpt WHEN 0 THEN '' ELSE content END) AS content FROM r
QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY rank DESC, CASE WHEN rank = 3 THEN length(regexp_replace(held, '\\s+', '', 'g')) ELSE 0 END DESC,
  stream, idx) = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.source_content(Store(spark, d).scoped).select("run_id", "url", "rank", _md5("content"))


@query("tool_result_no", f"""{E} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS no, idx AS index, tool_name FROM own
  WHERE kind = 'tool_result'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evidence.tool_result_no(Store(spark, d).own).select("run_id", "no", "index", "tool_name")


@query("tool_result_at", f"""{E}, tr AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS no, tool_name, md5(content) AS content FROM own
  WHERE kind = 'tool_result'), n AS (SELECT run_id, count(*) AS results FROM tr GROUP BY run_id), asked AS (SELECT run_id, unnest([0, 3, 9]) AS no FROM runs)
SELECT run_id, no, tool_name IS NOT NULL AS found, coalesce(results, 0) AS results, tool_name, content FROM asked LEFT JOIN n USING (run_id) LEFT JOIN tr USING (run_id, no)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    asked = store.runs.select("run_id", F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 3, 9)))).alias("no"))
    return evidence.tool_result_at(store.own, asked).withColumn("content", F.md5("content"))


@query("final_answer", f"{E}, {SAID} SELECT run_id, answer FROM said")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).answers


KID_SAID = """kid_said AS (SELECT t.run_id, t.child_id, t.mention, e.content AS answer FROM tasks t JOIN judged j ON j.session_id = t.child_id
  AND j.turn_no = t.turn_no AND j.finished JOIN ev e ON e.session_id = t.child_id AND e.idx = j.last_end_index WHERE t.last_task AND e.content <> '')"""
WHOLE = f"""{SAID}, {KID_SAID}, whole AS (SELECT run_id, string_agg(part, '' ORDER BY mention, child_id) AS answer FROM (
  SELECT run_id, -1 AS mention, '' AS child_id, answer AS part FROM said UNION ALL
  SELECT run_id, mention, child_id, chr(10) || chr(10) || '--- child ' || child_id || ' ---' || chr(10) || answer FROM kid_said) GROUP BY run_id)"""


@query("answer_with_children", f"{E}, {WHOLE} SELECT run_id, 0 AS page, answer FROM whole")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d, ())
    return evidence.answer_with_children(store.answers, evidence.child_answers(store.tasks, store.turns, store.events))


@query("resolve_citations", f"""{E}, {SAID}, cited AS (
  SELECT run_id, answer, 's' || split_part(run_id, '-', 3) || 'x' AS p FROM said)
SELECT run_id, regexp_replace(regexp_replace(answer, '<quote ref="none">(.*?)</quote>', '\\1'), '<citation [^>]*>both</citation>',
  'both (https://e.test/' || split_part(run_id, '-', 3) || '/a, https://e.test/' || split_part(run_id, '-', 3) || '/b)') AS answer FROM cited""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return answers.resolve_citations(store.answers, evidence.source_ids(store.scoped))


@query("referenced_artifacts", f"{E}, {REFERENCED} SELECT run_id, session_id, rel_path FROM names")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    said = store.answers.join(store.run_turns.select("run_id", F.col("session_id").alias("author")), "run_id")
    return answers.referenced_artifacts(said, corpora.artifacts(spark, d))


@query("rewrite_artifact_refs", f"{E}, {SAID} SELECT run_id, regexp_replace(answer, '\\(artifacts/(f[0-9]+\\.pdf)\\)', '(/copies/\\1)') AS answer FROM said")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    said = store.answers.join(store.run_turns.select("run_id", F.col("session_id").alias("author")), "run_id")
    refs = answers.artifact_mentions(said, corpora.artifacts(spark, d)).select(
        "run_id", "written", F.concat(F.lit("/copies/"), "rel_path").alias("copy"))
    return answers.rewrite_artifact_refs(store.answers, refs)


# --- verdicts -----------------------------------------------------------------------------

ORPHANS = """orphans AS (SELECT n.run_id, count(*) AS orphans FROM named n WHERE NOT EXISTS (SELECT 1 FROM tasks t JOIN judged j ON j.session_id = t.child_id
  AND j.turn_no = t.turn_no WHERE t.run_id = n.run_id AND t.child_id = n.child_id AND t.last_task AND j.finished) GROUP BY n.run_id)"""
STATE = f"""{ORPHANS}, activity AS (SELECT run_id, max(ts) AS last_ts FROM scoped GROUP BY run_id),
state AS (SELECT r.run_id, r.grp, coalesce(o.orphans, 0) AS orphans, CASE
  WHEN recorded IS NOT NULL THEN recorded WHEN rt.finished AND rt.failed THEN 'failed'
  WHEN exit_code <> 0 AND NOT ended_by_supervisor AND (rt.finished OR rt.turn_no IS NULL) THEN 'failed'
  WHEN rt.finished AND o.orphans > 0 THEN 'completed_with_orphans' WHEN rt.finished THEN 'completed'
  WHEN NOT supervised AND {corpora.NOW_MS} - created_at > 60000 THEN 'abandoned' WHEN NOT supervised THEN 'starting'
  WHEN rt.turn_no IS NULL AND exit_code IS NOT NULL THEN 'completed_unstructured' WHEN NOT alive THEN 'abandoned'
  WHEN {corpora.NOW_MS} - coalesce(a.last_ts, created_at) > 600000 THEN 'abandoned' ELSE 'running' END AS state
  FROM runs r LEFT JOIN rt USING (run_id) LEFT JOIN orphans o USING (run_id) LEFT JOIN activity a USING (run_id))"""


def _states(store: Store) -> DataFrame:
    found = store.run_turns.select("run_id", "turn_no", "finished", "failed", "session_id", F.col("error_index").alias("index"))
    errors = store.events.filter("error <> ''").select("session_id", "index", "error")
    known = found.join(errors, ["session_id", "index"], "left").drop("session_id", "index")
    every = store.runs.join(known, "run_id", "left")
    return states.run_state(every, states.run_activity(store.scoped), store.orphans, F.lit(corpora.NOW_MS))


@query("run_state", f"{E}, {STATE} SELECT run_id, state, orphans FROM state")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _states(Store(spark, d)).select("run_id", "state", "orphans")


@query("empty_result", f"""{E}, {SAID} SELECT r.run_id, NOT regexp_matches(coalesce(s.answer, ''), '\\S') AND (SELECT count(*) FROM ssrc x WHERE x.run_id = r.run_id) = 0 AS empty
  FROM runs r LEFT JOIN said s USING (run_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    total = evidence.source_summary(evidence.merge_sources(store.scoped))
    results = store.runs.select("run_id").join(store.answers, "run_id", "left").join(total, "run_id", "left")
    return states.empty_result(results).select("run_id", "empty")


@query("group_verdict", f"""{E}, {STATE}, {SAID},
res AS (SELECT st.*, NOT regexp_matches(coalesce(s.answer, ''), '\\S') AND NOT EXISTS (SELECT 1 FROM ssrc x WHERE x.run_id = st.run_id) AS empty
  FROM state st LEFT JOIN said s USING (run_id))
SELECT grp AS "group", CASE WHEN bool_or(state IN ('failed', 'abandoned')) THEN 4 WHEN bool_and(state NOT IN ('running', 'starting') AND empty) THEN 5 ELSE 0 END AS verdict,
  bool_or(state IN ('running', 'starting')) AS going FROM res GROUP BY grp""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    total = evidence.source_summary(evidence.merge_sources(store.scoped))
    results = (store.runs.select("run_id", "group").join(_states(store), "run_id").join(store.answers, "run_id", "left")
               .join(total, "run_id", "left"))
    return states.group_verdict(states.empty_result(results))


@query("run_report", f"""{E}, {STATE}, {SAID}, {MERGED},
total AS (SELECT run_id, count(*) AS n, count(*) FILTER (opened) AS o FROM numbered GROUP BY run_id),
used AS (SELECT run_id, sum(tokens)::BIGINT AS input, sum(tokens / 1024.0) AS cost FROM scoped WHERE kind = 'assistant' GROUP BY run_id)
SELECT st.run_id, st.state, st.orphans, coalesce(answer, '') AS answer, coalesce(n, 0) AS sources_total, coalesce(o, 0) AS sources_opened, coalesce(input, 0) AS total_tokens,
  coalesce(cost, 0) AS cost, NOT regexp_matches(coalesce(answer, ''), '\\S') AND coalesce(n, 0) = 0 AS empty, 0 AS unread
FROM state st LEFT JOIN said USING (run_id) LEFT JOIN total USING (run_id) LEFT JOIN used USING (run_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    summary = evidence.source_summary(evidence.merge_sources(store.scoped))
    report = reports.run_report(_states(store), store.answers, summary, evidence.usage_totals(store.scoped), states.unread_note(store.scoped))
    return report.select("run_id", "state", "orphans", "answer", "sources_total", "sources_opened", "total_tokens", "cost", "empty", "unread")


@query("unread_note", """SELECT 'c' || conv_id AS run_id, count(*) FILTER (role <> 'user') AS unread, count(*) FILTER (role <> 'user')
  || CASE count(*) FILTER (role <> 'user') WHEN 1 THEN ' record' ELSE ' records' END || ' in this run''s transcript could not be read' AS note FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'user') > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    role = F.when(F.col("role") == "user", "user").otherwise("tool-progress")
    raw = rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("index"),
                      F.to_json(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("raw"))
    return states.unread_note(events.normalize_events(raw).withColumnRenamed("session_id", "run_id"))


def _log(level: str, also: tuple[str, ...] | None = None):
    def build(spark: SparkSession, d: str) -> DataFrame:
        return logs.log_lines(Store(spark, d, also).scoped, level)
    return build


query("log_lines", f"""{E}, parts AS (
  SELECT run_id, stream, child_id, idx, 0 AS p, 'prompt: ' || left(split_part(content, chr(10), 1), 200)
      || CASE WHEN length(content) > least(length(split_part(content, chr(10), 1)), 200) THEN ' …(+' || (length(content) - least(length(split_part(content, chr(10), 1)), 200)) || ')' ELSE '' END AS line
    FROM scoped WHERE kind = 'user'
  UNION ALL SELECT s.run_id, s.stream, s.child_id, s.idx, 0, CASE WHEN s.stream < 0 THEN 'websearch×1' || CASE WHEN w.target <> '' THEN '[' || w.target || ']' ELSE '' END || ' webfetch×2[e.test, docs.test]' ELSE 'webfetch×1[e.test]' END
    FROM scoped s JOIN calls w ON w.session_id = s.session_id AND w.idx = s.idx AND w.pos = 0
  UNION ALL SELECT run_id, stream, child_id, idx, 1, 'answer: ' || left(split_part(content, chr(10), 1), 200)
      || CASE WHEN length(content) > least(length(split_part(content, chr(10), 1)), 200) THEN ' …(+' || (length(content) - least(length(split_part(content, chr(10), 1)), 200)) || ')' ELSE '' END
    FROM scoped WHERE kind = 'assistant' AND stop = 'end' AND content <> ''
  UNION ALL SELECT run_id, stream, child_id, idx, 2, 'error: ' || error FROM scoped WHERE error <> '')
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY stream, child_id, idx, p) - 1 AS line_no,
  CASE WHEN child_id = '' THEN line ELSE '[child ' || child_id || '] ' || line END AS line FROM parts""")(_log("progress", ("tool_name", "is_error", "error", "tool_calls", "unknown_blocks")))


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN left({text}, {n}) || '…(+' || (length({text}) - {n}) || ')' ELSE {text} END"


def _detail_sql(full: bool) -> str:
    """The lines of a log with calls and results, as SQL: a part for each thing an event shows, cut into lines."""
    wide = lambda n: 2000 if full else n
    said = lambda text: f"'{{\"objective\": ' || to_json({text})::VARCHAR || '}}'"
    url = lambda u: f"'{{\"url\": \"' || {u} || '\"}}'"
    call = lambda name, args: f"'call {name}(' || {_cut(args, wide(200))} || ')'"
    site = "'https://e.test/' || s.conv"
    n_results = "(SELECT count(*) FROM own o WHERE o.run_id = s.run_id AND o.kind = 'tool_result' AND o.idx < s.idx)"
    n_sources = "(SELECT count(*) FROM src x WHERE x.session_id = s.session_id AND x.idx = s.idx)"
    parts = [
        ("0", f"'user: ' || {_cut('content', wide(200))}", "kind = 'user'"), ("0", f"'system: ' || {_cut('content', wide(200))}", "kind = 'system'"),
        ("0", "'turn ' || lifecycle", "kind = 'lifecycle'"),
        ("0", call("websearch", said("(SELECT text FROM c WHERE c.conv = s.conv AND c.turn = s.turn)")), "kind = 'assistant' AND stop = 'tool' AND stream < 0"),
        ("1", call("webfetch", url(f"{site} || '/b'")), "kind = 'assistant' AND stop = 'tool' AND stream < 0"),
        ("2", call("webfetch", url("'https://docs.test/' || s.conv")), "kind = 'assistant' AND stop = 'tool' AND stream < 0"),
        ("0", call("webfetch", url(f"{site} || '/a'")), "kind = 'assistant' AND stop = 'tool' AND stream >= 0"),
        ("3", _cut("content", wide(400)), "kind = 'assistant' AND content <> ''"), ("4", "'error: ' || error", "kind = 'assistant' AND error <> ''"),
        ("0", f"CASE WHEN stream < 0 THEN '#' || {n_results} || ' ' ELSE '' END || tool_name || ' out=' || length(content) || 'B' || CASE WHEN {n_sources} > 0 THEN ' sources=' || {n_sources} ELSE '' END",
         "kind = 'tool_result'")]
    if full:
        parts.append(("1", _cut("content", 2000), "kind = 'tool_result' AND content <> ''"))
    rows = " UNION ALL ".join(f"SELECT run_id, stream, child_id, idx, {p} AS p, {text} AS part FROM scoped s WHERE {where}" for p, text, where in parts)
    return f"""{E}, parts AS ({rows}),
cut AS (SELECT run_id, stream, child_id, idx, p, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS k FROM parts)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY stream, child_id, idx, p, k) - 1 AS line_no,
  CASE WHEN child_id = '' THEN line ELSE '[child ' || child_id || ']' || CASE WHEN line = '' THEN '' ELSE ' ' || line END END AS line FROM cut"""


query("log_lines_steps", _detail_sql(False))(_log("steps"))
query("log_lines_full", _detail_sql(True))(_log("full"))
query("log_lines_raw", f"""{E} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY stream, child_id, idx) - 1 AS line_no, session_id || ' ' || ts || ' ' || kind AS line
  FROM scoped""")(lambda spark, d: _raw_lines(spark, d))


def _raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """A raw line is the record as it was written; what the SQL can say of it is read back from the line, its session is the event's."""
    lines = logs.log_lines(Store(spark, d, ("raw",)).scoped, "raw", also=("session_id",))
    said = F.from_json("line", "role string, event string, timestamp bigint")
    kind = F.when(said["role"] == "turn-lifecycle", "lifecycle").when(said["role"] == "toolResult", "tool_result").when(said["role"] == "system-message", "system").otherwise(said["role"])
    return lines.select("run_id", "line_no", F.concat_ws(" ", "session_id", said["timestamp"].cast("string"), kind).alias("line"))


@query("tool_usage_progress", f"""{E} SELECT session_id, idx AS index, string_agg(name || '×' || n || CASE WHEN t <> '' THEN '[' || t || ']' ELSE '' END, ' ' ORDER BY p) AS usage FROM (
  SELECT session_id, idx, name, count(*) AS n, coalesce(string_agg(target, ', ' ORDER BY pos) FILTER (target <> ''), '') AS t, min(pos) AS p FROM calls GROUP BY session_id, idx, name)
  GROUP BY session_id, idx""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return logs.tool_usage_progress(Store(spark, d).typed)


# --- audits -------------------------------------------------------------------------------


@query("known_tools_audit", f"{E} SELECT name, count(*) AS calls FROM calls WHERE name NOT IN ('websearch') GROUP BY name")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.known_tools_audit(Store(spark, d).typed, ["websearch"])


@query("record_counts", f"{E} SELECT session_id, count(*) AS records, count(*) FILTER (idx % 17 <> 0) AS events FROM ev GROUP BY session_id HAVING count(*) <> count(*) FILTER (idx % 17 <> 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The audit over a typing that lost records: it names the sessions they are missing from."""
    store = Store(spark, d)
    return audit.record_counts(store.raw, store.typed.filter("index % 17 <> 0"))


@query("saved_path_audit", f"{E} SELECT DISTINCT session_id, idx AS index, saved_path FROM src WHERE saved_path <> '' AND saved_path NOT LIKE '%/doc1.pdf'")
def _(spark: SparkSession, d: str) -> DataFrame:
    # read twice: records are typed once
    typed = stored(Store(spark, d).typed.select("session_id", "index", "sources"), "events")
    there = events.downloads(typed).filter(F.col("saved_path").endswith("/doc1.pdf")).select(F.col("saved_path").alias("path"))
    return audit.saved_path_audit(typed, there)


@query("session_profile", f"""{E} SELECT session_id, tool_name AS tool, count(*) AS results, 0 AS errors, count(child) AS children, max(duration) AS longest_ms, quantile_disc(duration, 0.5) AS median_ms
  FROM ev WHERE kind = 'tool_result' GROUP BY ROLLUP (session_id, tool_name) HAVING session_id IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.session_profile(Store(spark, d).typed)


@query("session_kinds", f"""{E} SELECT session_id, count(*) FILTER (kind = 'user') AS "user", count(*) FILTER (kind = 'assistant') AS assistant,
  count(*) FILTER (kind = 'tool_result') AS tool_result, count(*) FILTER (kind = 'system') AS "system", count(*) FILTER (kind = 'lifecycle') AS lifecycle,
  0 AS meta, 0 AS raw, 0 AS oversized, sum(tokens)::BIGINT AS total_tokens, max(ts) - min(ts) AS span_ms FROM ev GROUP BY session_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return audit.session_kinds(Store(spark, d).typed)


# --- time ---------------------------------------------------------------------------------

HOUR_MS = 3_600_000


def _ms_events(spark: SparkSession, d: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{d}/events.parquet"), "event_id")
    return table.select("event_id", "user_id", F.floor(corpora.micros(table, "ts") / 1000).alias("ts"), "event_type")


@query("activity_sessions", f"""WITH m AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM m),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {HOUR_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS no FROM g)
SELECT user_id, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n FROM s GROUP BY user_id, no""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return states.activity_sessions(_ms_events(spark, d), HOUR_MS)


@query("idle_abandon", f"""{E}, activity AS (SELECT run_id, max(ts) AS last_ts FROM scoped GROUP BY run_id)
SELECT rt.run_id, a.last_ts, NOT rt.finished AND {corpora.NOW_MS} - coalesce(a.last_ts, r.created_at) > 600000 AS abandoned
FROM rt JOIN runs r USING (run_id) LEFT JOIN activity a USING (run_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    judged = states.idle_abandon(store.run_turns, states.run_activity(store.scoped), F.lit(corpora.NOW_MS))
    return judged.select("run_id", "last_ts", "abandoned")


@query("settle_window", f"""{E} SELECT t.run_id, t.child_id, coalesce(CASE WHEN j.finished THEN j.last_ts END <= rt.last_ts - 3000 + 500, false) AS settled
FROM tasks t JOIN judged j ON j.session_id = t.child_id AND j.turn_no = t.turn_no JOIN rt ON rt.run_id = t.run_id WHERE t.last_task""")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    ended = store.run_turns.select("run_id", (F.col("last_ts") - 3000).alias("ended_ts"))
    finished = store.tasks.filter("last_task").hint("merge").join(
        store.turns.select(F.col("session_id").alias("child_id"), "turn_no", F.when(F.col("finished"), F.col("last_ts")).alias("finished_ts")),
        ["child_id", "turn_no"]).select("run_id", "child_id", "finished_ts")
    return states.settle_window(ended, finished, 500)


@query("scan_artifacts", f"{E} SELECT session_id, rel_path FROM art")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "home")
    files = corpora.artifacts(spark, d)
    write_files(files.select(F.concat(F.lit("2024-01-01_"), "session_id", F.lit("/artifacts/"), "rel_path").alias("file"), F.col("path").alias("value")), folder)
    return transcripts.scan_artifacts(spark, folder).select("session_id", "rel_path")
