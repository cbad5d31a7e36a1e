"""Queries over links, listings and site walks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import html_unescape_attr, main_text, same_site, site_of, url_key, word_count
from pagewright.operators import attempts, links, sitegraph
from pagewright.plans import corpora, sqltext
from pagewright.plans.page_queries import LAST
from pagewright.plans.registry import query
from pagewright.plans.scratch import scratch
from pagewright.session import reliable, stored
from pagewright.sources import manifests

DEPTH = 3
MAX_URLS = 12

LINKS = f"WITH {sqltext.LINKS_SQL}"
SITES = f"{LINKS}, {sqltext.SITES_SQL}"
LISTED = f"{SITES}, {sqltext.SITEMAP_SQL}"
ALL_LISTS = f"""lists AS (
  SELECT root, min(ord) AS ord, arg_min(url, ord) AS url FROM listed
  WHERE url LIKE 'http%' AND {sqltext.site_of('url')} = {sqltext.site_of('root')} GROUP BY root, {sqltext.url_key('url')})"""
OWN_LIST = f"{ALL_LISTS}, own AS (SELECT * FROM lists WHERE root LIKE 'https://%')"
WALK = f"WITH RECURSIVE {sqltext.LINKS_SQL}, {sqltext.SITES_SQL}, {sqltext.walk_sql(DEPTH)}"
LISTING = f"""{WALK}, {sqltext.SITEMAP_SQL}, {OWN_LIST},
listing AS (
  SELECT root, url, lpad(ord::VARCHAR, 19, '0') AS ord, true AS from_sitemap FROM own
  UNION ALL
  SELECT root, url, ord, false FROM walked WHERE root NOT IN (SELECT root FROM own)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord, url) AS r FROM listing)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return links.extract_links(corpora.pages(spark, d))


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.discover(corpora.site_edges(spark, d), corpora.site_roots(spark, d), DEPTH)


def _own_lists(spark: SparkSession, d: str) -> DataFrame:
    return links.sitemap_urls(corpora.sitemap_records(spark, d))


def _sitemap(spark: SparkSession, d: str) -> DataFrame:
    """The lists of the sites that offer one to a map: those under https."""
    return _own_lists(spark, d).filter(F.col("root").startswith("https://"))


def _listing(spark: SparkSession, d: str, cap: int | None = None) -> DataFrame:
    walk = sitegraph.discover(corpora.site_edges(spark, d), corpora.site_roots(spark, d), DEPTH, cap)
    return sitegraph.choose_listing(walk, _sitemap(spark, d))


@query("extract_links", f"{LINKS} SELECT url, pos, href FROM links")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).filter(F.col("pos").isNotNull()).select("url", "pos", "href")


@query("html_unescape_attr", f"""{LINKS} SELECT url, pos, replace(href, '&amp;', '&') || '?id=1&lang=ko&copy=2&q=©' AS value FROM links""")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _links(spark, d).filter(F.col("pos").isNotNull())
    written = F.concat("href", F.lit("?id=1&#38lang=ko&copy=2&amp;q=&copy"))
    return found.select("url", "pos", html_unescape_attr(written).alias("value"))


@query("resolve_links", f"{LINKS} SELECT src, pos, dst FROM resolved")
def _(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve_links(_links(spark, d)).filter(F.col("pos").isNotNull()).select("src", "pos", "dst")


@query("same_site", f"""{SITES} SELECT dst, count(*) AS n, bool_and({sqltext.site_of('dst')} = {sqltext.site_of('src')}) AS same
  FROM edges WHERE dst IS NOT NULL GROUP BY dst""")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = corpora.site_edges(spark, d).filter(F.col("dst").isNotNull())
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.every(same_site(F.col("src"), F.col("dst"))).alias("same"))


@query("url_key", f"SELECT page_id, {sqltext.url_key('url')} AS key FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return corpora.pages(spark, d).select("page_id", url_key(F.col("url")).alias("key"))


@query("dedupe_urls", f"""{LISTED} SELECT root, min(ord) AS ord, arg_min(url, ord) AS url FROM listed WHERE url LIKE 'http%'
  GROUP BY root, {sqltext.url_key('url')}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return links.dedupe_urls(corpora.sitemap_records(spark, d).filter(F.col("url").startswith("http")))


@query("dropped_other_origin", f"""{LISTED} SELECT root, count(DISTINCT url) AS n FROM listed
  WHERE url LIKE 'http%' AND {sqltext.site_of('url')} <> {sqltext.site_of('root')} GROUP BY root""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return links.dropped_other_origin(corpora.sitemap_records(spark, d).select("root", "url"))


@query("dropped_over_crawls", f"""{LISTED} SELECT root, count(DISTINCT url) AS n FROM listed
  WHERE url LIKE 'http%' AND {sqltext.site_of('url')} <> {sqltext.site_of('root')} GROUP BY root""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # three crawls that saw different parts, written down as sketches
    crawled = corpora.sitemap_records(spark, d).select("root", "url", F.pmod("ord", F.lit(3)).alias("crawl_id"))
    return links.dropped_over_crawls(stored(links.dropped_sketches(crawled), "sketches"))


@query("sitemap_candidates", f"""{SITES} SELECT root, o || p AS url FROM (
  SELECT root, {sqltext.ext('root', '^([A-Za-z]+://[^/?#]*)')} AS o, unnest(['/sitemap.xml', '/robots.txt']) AS p FROM roots)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return links.sitemap_candidates(corpora.site_roots(spark, d)).select("root", "url")


@query("sitemap_urls", f"{LISTED}, {ALL_LISTS} SELECT root, ord, url FROM lists")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _own_lists(spark, d)


@query("sitemap_locs", f"""SELECT {sqltext.site_of('url')} AS root, page_id * 2 + i AS ord, url || CASE i WHEN 0 THEN '' ELSE '?a=1&b=2' END AS url
  FROM pages, (SELECT unnest([0, 1]) AS i)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    bodies = corpora.pages(spark, d).select(site_of(F.col("url")).alias("root"), "page_id", F.concat(
        F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><loc> "),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("?a=1&amp;b=2 </loc></url></urlset>")).alias("text"))
    one = links.sitemap_locs(bodies.select(F.concat_ws("\n", "root", F.col("page_id").cast("string")).alias("root"), "text"))
    return one.select(F.split("root", "\n")[0].alias("root"), (F.split("root", "\n")[1].cast("long") * 2 + F.col("ord")).alias("ord"), "url")


@query("discover", f"{WALK} SELECT root, url, depth, ord, read FROM walked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


@query("discover_capped", f"""{WALK}, fill AS (
  SELECT root, min(depth) AS last FROM (SELECT root, depth, sum(count(*)) OVER (PARTITION BY root ORDER BY depth) AS kept FROM walked GROUP BY root, depth)
  WHERE kept >= {MAX_URLS} GROUP BY root)
SELECT w.root, url, depth, ord, read FROM walked w LEFT JOIN fill ON fill.root = w.root WHERE depth <= coalesce(last, {DEPTH})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.discover(corpora.site_edges(spark, d), corpora.site_roots(spark, d), DEPTH, MAX_URLS)


@query("choose_listing", f"{LISTING} SELECT root, url, ord, from_sitemap FROM listing")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _listing(spark, d)


@query("cap_urls", f"{LISTING} SELECT root, url, ord FROM ranked WHERE r <= {MAX_URLS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.cap_urls(_listing(spark, d, MAX_URLS), MAX_URLS).select("root", "url", "ord")


@query("coverage", f"""{LISTING},
own_walk AS (SELECT * FROM walked WHERE root NOT IN (SELECT root FROM own)),
counts AS (SELECT root, count(*) FILTER (read) AS pages_read, count(*) FILTER (NOT read) AS missed FROM own_walk GROUP BY root),
firsts AS (SELECT root, string_agg(url, ' ' ORDER BY r) AS urls FROM (
  SELECT root, url, row_number() OVER (PARTITION BY root ORDER BY ord, url) AS r FROM own_walk WHERE NOT read) WHERE r <= 10 GROUP BY root),
away AS (SELECT root, count(DISTINCT url) AS n FROM listed WHERE url LIKE 'http%' AND {sqltext.site_of('url')} <> {sqltext.site_of('root')} GROUP BY root)
SELECT roots.root, roots.root IN (SELECT root FROM own) AS sitemap, coalesce(pages_read, 0) AS pages_read, coalesce(urls, '') AS pages_missed,
  coalesce(missed, 0) AS pages_missed_count, length(roots.root) % 3 = 0 AS budget_exhausted,
  (SELECT count(*) FROM listing l WHERE l.root = roots.root) >= {MAX_URLS} AS max_urls_reached, coalesce(away.n, 0) AS dropped_other_origin,
  roots.root NOT IN (SELECT root FROM own) AND coalesce(pages_read, 0) = 0 AS nothing_read
FROM roots LEFT JOIN counts USING (root) LEFT JOIN firsts USING (root) LEFT JOIN away USING (root)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    walk, roots = _walk(spark, d), corpora.site_roots(spark, d)
    listed = sitegraph.choose_listing(walk, _sitemap(spark, d))
    dropped = links.dropped_other_origin(corpora.sitemap_records(spark, d).select("root", "url"))
    budgets = roots.select("root", (F.length("root") % 3 == 0).alias("hit_budget"))
    report = sitegraph.coverage(walk, listed, roots, dropped, budgets, MAX_URLS)
    return report.withColumn("pages_missed", F.array_join("pages_missed", " "))


@query("map_summary", f"""{LISTING} SELECT root, count(*) AS count, string_agg(url, ' ' ORDER BY r) FILTER (r <= 10) AS sample FROM ranked GROUP BY root""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.map_summary(_listing(spark, d)).withColumn("sample", F.array_join("sample", " "))


@query("crawl_frontier", f"{LISTING} SELECT root, url, r <= 5 AS requested FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.crawl_frontier(_listing(spark, d), 5).select("root", "url", "requested")


@query("frontier_counts", f"""{LISTING} SELECT root, count(*) FILTER (r <= 5) AS requested, count(*) AS discovered,
  count(*) FILTER (r > 5) AS not_crawled FROM ranked GROUP BY root""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sitegraph.frontier_counts(sitegraph.crawl_frontier(_listing(spark, d), 5))


@query("recrawl_set", f"""{SITES} SELECT site AS root, url, row_number() OVER (PARTITION BY site ORDER BY page_id % 2, page_id) - 1 AS n FROM sites""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = corpora.pages(spark, d).select(site_of(F.col("url")).alias("root"), "page_id", "url")
    crawled = rows.filter("page_id % 2 = 0").select("root", F.col("page_id").alias("n"), "url")
    left = rows.filter("page_id % 2 = 1").select("root", F.col("page_id").alias("ord"), "url")
    again = sitegraph.recrawl_set(crawled, left)
    place = F.struct("part", F.floor(F.col("ord").cast("long") / 4096))
    from pagewright.operators.ordered import numbered
    return numbered(again, ["root"], ["part", "ord"], "n", place).select("root", "url", "n")


@query("crawl_report", f"""{LAST},
items AS (SELECT {sqltext.site_of('f.url')} AS root, (SELECT min(page_id) FROM pages p WHERE p.url = f.url) AS n, f.url,
  CASE WHEN t.url IS NOT NULL AND t.kind <> 'error' THEN t.status ELSE f.status END AS status,
  CASE WHEN t.url IS NOT NULL AND t.kind <> 'error' THEN t.http_status ELSE f.http_status END AS http_status FROM f LEFT JOIN t ON t.url = f.url),
per AS (SELECT root, status, count(*) AS c FROM items GROUP BY root, status),
bad AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n, url) AS r FROM items WHERE status <> 'ok')
SELECT root, sum(c)::BIGINT AS requested, coalesce(sum(c) FILTER (status = 'ok'), 0)::BIGINT AS saved,
  string_agg(status || ' ' || c, ',' ORDER BY status) AS statuses, coalesce(sum(c) FILTER (status <> 'ok'), 0)::BIGINT AS not_ok_count,
  coalesce((SELECT string_agg(url || ' ' || status || ' ' || http_status, ',' ORDER BY r) FROM bad b WHERE b.root = per.root AND r <= 10), '') AS not_ok
FROM per GROUP BY root""")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = (attempts.resolved_statuses(corpora.fetch_log(spark, d), place="page_id", n=F.min("page_id"))
             .select(site_of(F.col("url")).alias("root"), "n", "url", "status", "http_status"))
    # a crawl's items are read twice: once written down, the pages are not judged again
    report = sitegraph.crawl_report(reliable(items))
    said = F.transform("not_ok", lambda r: F.concat_ws(" ", r["url"], r["status"], r["http_status"].cast("string")))
    statuses = F.transform(F.map_entries("statuses"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string")))
    return report.select("root", "requested", "saved", F.array_join(statuses, ",").alias("statuses"), "not_ok_count",
                         F.coalesce(F.array_join(said, ","), F.lit("")).alias("not_ok"))


@query("write_manifest", f"""{SITES} SELECT site AS root, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS ord, url FROM sites""")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "map")
    listing = corpora.pages(spark, d).select(site_of(F.col("url")).alias("root"), F.col("page_id").alias("ord"), "url")
    manifests.write_manifest(listing, folder)
    return manifests.read_manifest(spark, folder)


@query("read_manifest", f"""{SITES}, n AS (SELECT *, page_id % 3 = 0 AS kept FROM sites)
SELECT site AS root, row_number() OVER (PARTITION BY site ORDER BY NOT kept, page_id) - 1 AS place, url FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "crawl")
    rows = corpora.pages(spark, d).withColumn("root", site_of(F.col("url"))).withColumn("words", word_count(main_text(F.col("text"))))
    none = F.lit(None).cast("string")
    kept = rows.filter("page_id % 3 = 0").select(
        "root", F.col("page_id").alias("n"), "url", "final_url", none.alias("file"), none.alias("title"), F.lit("ok").alias("status"),
        F.lit("fetch").alias("via"), "words", F.col("status").alias("http_status"), none.alias("error"))
    left = rows.filter("page_id % 3 <> 0").select("root", F.col("page_id").alias("ord"), "url")
    manifests.write_crawl_manifest(kept, left, folder)
    listed = manifests.read_manifest(spark, folder)
    from pagewright.operators.ordered import chunk_of, numbered
    return numbered(listed, ["root"], ["ord"], "place", chunk_of(F.col("ord"))).select("root", "place", "url")
