"""Walking a site's links, and what a map or crawl reports.

A page's place in a walk, ``ord``, is a sortable text: its depth, then the position of each link on the way to it, each number
after its own number of digits. Text order is the order of discovery, so no level has to number its pages.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import same_site, url_key
from pagewright.operators.ordered import first_n, salted_join
from pagewright.session import reliable

#: Pages a crawl fetches when it discovered them itself.
MAX_PAGES = 25
#: Rows a report lists of a group of any size.
SHOWN = 10


def sortable(n: Column) -> Column:
    """A whole number from 0 as a text that sorts like it: two digits that say how many follow."""
    digits = n.cast("long").cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), digits)


def discover(edges: DataFrame, roots: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """Walk every root's site breadth-first: ``(root, url, depth, ord, read)``.

    ``edges`` holds ``(src, pos, dst)`` with a row without ``dst`` for a page without links. Each page comes once, under
    the first spelling met, in order of discovery. Pages above ``depth`` are read; ``read`` says whether they could be,
    and is null on the last level. One job a level for all roots together; each level is checkpointed, so a lost executor
    repeats one level and the plan does not grow. A root with ``cap`` pages or more leaves the walk with the level that brought them: its pages
    found so far are asked, so a miss among them counts, but none of their links is followed. Its first ``cap`` pages are those of the whole walk.
    """
    # copies of a page repeat its links: one row per target, counted before the first shuffle
    # a root's pages all lie on its site, so links that leave their own page's site go before anything is written
    linked = (edges.select(url_key(F.col("src")).alias("src_key"), "pos", F.when(same_site(F.col("src"), F.col("dst")), F.col("dst")).alias("dst"))
              .groupBy("src_key", "dst").agg(F.min("pos").alias("pos")))
    linked = reliable(linked)
    pages_read = reliable(linked.select("src_key").distinct())
    linked = linked.filter(F.col("dst").isNotNull())
    level = roots.select("root", F.col("root").alias("url"), url_key(F.col("root")).alias("key"), F.lit("").alias("way")).distinct()
    visited = None
    for d in range(depth + 1):
        asked = d < depth
        if asked:
            known = pages_read.withColumnRenamed("src_key", "key").withColumn("_known", F.lit(True))
            level = level.join(known, "key", "left").withColumn("read", F.col("_known").isNotNull()).drop("_known")
        else:
            level = level.withColumn("read", F.lit(None).cast("boolean"))
        level = reliable(level.withColumn("depth", F.lit(d)).select("root", "key", "url", "way", "depth", "read"))
        visited = level if visited is None else visited.unionByName(level)
        if not asked or level.isEmpty():
            break
        going = level.filter("read")
        if cap is not None:
            full = reliable(visited.groupBy("root").agg(F.count("*").alias("_n")).filter(F.col("_n") >= cap).select("root"))
            going = salted_join(going, full, ["root"], F.col("key"), how="left_anti")
        steps = going.select("root", "way", F.col("key").alias("src_key")).join(linked, "src_key")
        way = F.concat("way", sortable(F.col("pos")))
        found = (steps.groupBy("root", url_key(F.col("dst")).alias("key")).agg(F.min(F.struct(way.alias("way"), "dst")).alias("_first"))
                 .select("root", "key", F.col("_first.way").alias("way"), F.col("_first.dst").alias("url")))
        level = found.join(visited.select("root", "key"), ["root", "key"], "left_anti")
    place = F.concat(sortable(F.col("depth")), "way")
    return visited.select("root", "url", "depth", place.alias("ord"), "read")


def cap_urls(listing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages of each root in order."""
    return first_n(listing, ["root"], ["ord", "url"], n).drop("_rank")


def choose_listing(walk: DataFrame, sitemap: DataFrame, use_sitemap: bool = True) -> DataFrame:
    """``(root, url, ord, from_sitemap)``: a site's own list where it has one, else its walk."""
    walked = walk.select("root", "url", F.col("ord").cast("string").alias("ord"), F.lit(False).alias("from_sitemap"))
    if not use_sitemap:
        return walked
    listed = sitemap.select("root", "url", F.lpad(F.col("ord").cast("string"), 19, "0").alias("ord"),
                            F.lit(True).alias("from_sitemap"))
    without = salted_join(walked, listed.select("root").distinct(), ["root"], F.col("url"), how="left_anti")
    return listed.unionByName(without)


def coverage(walk: DataFrame, listing: DataFrame, roots: DataFrame, dropped: DataFrame, budgets: DataFrame,
             max_urls: int, shown: int = SHOWN) -> DataFrame:
    """One row a root: how much of it was read, what was missed and why discovery stopped.

    ``walk`` as from ``discover``; ``listing`` as from ``choose_listing``, before any cap; ``dropped`` as from
    ``dropped_other_origin``; ``budgets`` holds ``(root, hit_budget)``.
    """
    own = salted_join(walk, listing.filter("from_sitemap").select("root").distinct(), ["root"], F.col("url"), how="left_anti")
    read = own.groupBy("root").agg(F.count_if("read").alias("pages_read"), F.count_if(~F.col("read")).alias("pages_missed_count"))
    missed = (first_n(own.filter(~F.col("read")), ["root"], ["ord", "url"], shown).groupBy("root")
              .agg(F.array_sort(F.collect_list(F.struct("_rank", "url"))).alias("_missed"))
              .select("root", F.transform("_missed", lambda m: m["url"]).alias("pages_missed")))
    found = listing.groupBy("root").agg(F.count("*").alias("_found"), F.max("from_sitemap").alias("sitemap"))
    cut = budgets.groupBy("root").agg(F.max("hit_budget").alias("budget_exhausted"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return (roots.select("root").distinct().join(read, "root", "left").join(missed, "root", "left").join(found, "root", "left")
            .join(cut, "root", "left").join(dropped.withColumnRenamed("n", "_dropped"), "root", "left")
            .select("root", F.coalesce("sitemap", no).alias("sitemap"), F.coalesce("pages_read", zero).alias("pages_read"),
                    F.coalesce("pages_missed", F.array().cast("array<string>")).alias("pages_missed"),
                    F.coalesce("pages_missed_count", zero).alias("pages_missed_count"),
                    F.coalesce("budget_exhausted", no).alias("budget_exhausted"),
                    (F.coalesce("_found", zero) >= max_urls).alias("max_urls_reached"),
                    F.coalesce("_dropped", zero).alias("dropped_other_origin"),
                    (~F.coalesce("sitemap", no) & (F.coalesce("pages_read", zero) == 0)).alias("nothing_read")))


def map_summary(listing: DataFrame, k: int = SHOWN) -> DataFrame:
    """``(root, count, sample)``: a site's size and its first pages, whatever the size."""
    sample = (first_n(listing, ["root"], ["ord", "url"], k).groupBy("root")
              .agg(F.array_sort(F.collect_list(F.struct("_rank", "url"))).alias("_s"))
              .select("root", F.transform("_s", lambda r: r["url"]).alias("sample")))
    return listing.groupBy("root").agg(F.count("*").alias("count")).join(sample, "root")


def crawl_frontier(listing: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """``listing`` with ``requested``: the first ``max_pages`` pages of each root; without a cap, all of them.

    The cap is for listings a crawl discovered itself; one from a manifest is crawled whole unless a cap is given.
    """
    if max_pages is None:
        return listing.withColumn("requested", F.lit(True))
    last = (first_n(listing, ["root"], ["ord", "url"], max_pages).groupBy("root")
            .agg(F.max(F.struct("ord", "url")).alias("_last")))
    placed = salted_join(listing, last, ["root"], F.col("url"))
    return placed.withColumn("requested", F.struct("ord", "url") <= F.col("_last")).drop("_last")


def frontier_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("root").agg(F.count_if("requested").alias("requested"), F.count("*").alias("discovered"),
                                        F.count_if(~F.col("requested")).alias("not_crawled"))


def recrawl_set(pages: DataFrame, left: DataFrame) -> DataFrame:
    """``(root, part, ord, url)``: a crawl's own pages and then what it left, in the order to crawl them again."""
    def place(name: str) -> Column:
        return F.lpad(F.col(name).cast("string"), 19, "0").alias("ord")

    return (pages.select("root", F.lit(0).alias("part"), place("n"), "url")
            .unionByName(left.select("root", F.lit(1).alias("part"), place("ord"), "url")))


def crawl_report(items: DataFrame, k: int = SHOWN) -> DataFrame:
    """One row a crawl: how many pages were asked for and saved, the statuses, and the first failures.

    ``items`` holds ``(root, n, url, status, http_status)``.
    """
    counts = items.groupBy("root", "status").agg(F.count("*").alias("_n"))
    statuses = counts.groupBy("root").agg(
        F.sum("_n").alias("requested"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("_n"))), F.lit(0)).alias("saved"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "_n")))).alias("statuses"))
    failed = (first_n(items.filter(F.col("status") != "ok"), ["root"], ["n", "url"], k).groupBy("root")
              .agg(F.array_sort(F.collect_list(F.struct("_rank", "url", "status", "http_status"))).alias("_f"))
              .select("root", F.transform("_f", lambda r: F.struct(r["url"].alias("url"), r["status"].alias("status"),
                                                                   r["http_status"].alias("http_status"))).alias("not_ok")))
    return (statuses.join(failed, "root", "left")
            .withColumn("not_ok_count", F.col("requested") - F.col("saved")))
