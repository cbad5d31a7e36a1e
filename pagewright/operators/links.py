"""Links of pages: extraction, resolution, identity."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.markup import html_unescape_attr, without_scripts
from pagewright.functions.urls import origin, resolve_href, same_site, url_key, valid_web_url

HREF = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def extract_links(pages: DataFrame) -> DataFrame:
    """``(url, final_url, pos, href)`` of every link of a page; a page without links keeps one row without an href.

    The href is as written; markup inside comments and scripts is not a link.
    """
    found = F.regexp_extract_all(without_scripts(F.col("text")), F.lit(HREF), 1)
    return (pages.select("url", "final_url", F.posexplode_outer(found).alias("pos", "_raw"))
            .select("url", "final_url", "pos", F.regexp_replace("_raw", r"^[\"']|[\"']$", "").alias("href")))


def hrefs_of(records: DataFrame) -> DataFrame:
    """The links of link records (``kind, url, final_url, hrefs``), in the shape of ``extract_links``."""
    return (records.filter(F.col("kind") == "hrefs")
            .select("url", "final_url", F.posexplode_outer("hrefs").alias("pos", "href")))


def resolve_links(links: DataFrame) -> DataFrame:
    """``(src, final_url, pos, dst)``: where each link leads, read against the page's final URL.

    A link that names no web page has no ``dst``; the row stays, because it also says its page was read.
    """
    target = resolve_href(F.col("final_url"), html_unescape_attr(F.col("href")))
    return links.select(F.col("url").alias("src"), "final_url", "pos", target.alias("dst"))


def dedupe_urls(df: DataFrame, by: str = "root") -> DataFrame:
    """One row a page: of several spellings, the first in order. ``df`` holds ``(by, ord, url)``."""
    first = F.min(F.struct("ord", "url"))
    return (df.groupBy(by, url_key(F.col("url")).alias("_key")).agg(first.alias("_first"))
            .select(by, F.col("_first.ord").alias("ord"), F.col("_first.url").alias("url")))


def dropped_other_origin(links: DataFrame) -> DataFrame:
    """``(root, n)``: the distinct web pages of other sites that a root's links or listing name.

    ``links`` holds ``(root, url)``. Duplicates fall away by partial aggregation before anything is shuffled.
    """
    away = links.filter(valid_web_url(F.col("url")) & ~same_site(F.col("root"), F.col("url")))
    return away.select("root", url_key(F.col("url")).alias("_key")).distinct().groupBy("root").agg(F.count("*").alias("n"))


def dropped_sketches(links: DataFrame, crawl: str = "crawl_id", bits: int = 14) -> DataFrame:
    """``(root, crawl, sketch)``: what ``dropped_other_origin`` counts, as a mergeable sketch of each root and crawl, to be stored beside the exact count.

    A sketch takes at most some ``2 ** bits`` bytes however many pages it saw; a thousand and fewer it counts exactly but for one in millions.
    """
    away = links.filter(valid_web_url(F.col("url")) & ~same_site(F.col("root"), F.col("url")))
    return away.groupBy("root", crawl).agg(F.hll_sketch_agg(url_key(F.col("url")), bits).alias("sketch"))


def dropped_over_crawls(sketches: DataFrame) -> DataFrame:
    """``(root, n)``: the distinct pages of other sites over all crawls of a root, from their sketches alone; no link is read again. Off by some 1.04 / 2 ** (bits / 2) of it."""
    return sketches.groupBy("root").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def sitemap_candidates(roots: DataFrame) -> DataFrame:
    """``(root, ord, url)``: where a site's own list of its pages would be."""
    base = origin(F.col("root"))
    places = F.array(F.concat(base, F.lit("/sitemap.xml")), F.concat(base, F.lit("/robots.txt")))
    return roots.select("root", F.posexplode(places).alias("ord", "url"))


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """``(root, ord, url)`` of the ``<loc>`` values in sitemap bodies ``(root, text)``."""
    locs = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    return bodies.select("root", F.posexplode(locs).alias("ord", "_loc")).select(
        "root", F.col("ord").cast("long"), html_unescape_attr(F.col("_loc")).alias("url"))


def sitemap_urls(listed: DataFrame) -> DataFrame:
    """The listed pages of a root's own site, each once. Relative entries and other sites' pages fall away."""
    own = listed.filter(same_site(F.col("root"), F.col("url")))
    return dedupe_urls(own.select("root", "ord", "url"))
