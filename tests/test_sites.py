"""Sites against plain models: resolution beside the standard library's, walks beside breadth-first search, attempts beside a plain reading of the rules."""
from __future__ import annotations

import random
from collections import defaultdict
from html import unescape
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html_unescape_attr, same_site, site_of, url_key
from pagewright.functions.urls import resolve_href
from pagewright.operators import attempts, links, sitegraph
from pagewright.sources import manifests

# --- URLs ---


def test_hrefs_resolve_like_the_standard_library(table) -> None:
    bases = ["https://b.test/x/y/z.html?q=1", "http://b.test:8080/", "https://b.test"]
    hrefs = ["", "w", "./w", "../w", "../../../w", "/a/./b/../c", "//other.test/p", "?k=v", "#f", "w?x=/../y", "w#a?b", "https://far.test", "HTTP://b.test/A", "x/.", "x/..", ";p=1", "a:b/c"]
    blanks = [(f"\n\t {h} \r\x01", h) for h in hrefs if h] + [("\n  /x", "/x"), ("/a b/c d", "/a%20b/c%20d"), ("/li\nne", "/line")]
    rows = [(b, h, p) for b in bases for h, p in [*((h, h) for h in hrefs), *blanks]]
    got = table("b string, h string, p string", rows).select("b", "h", "p", resolve_href(F.col("b"), F.col("h")).alias("u")).collect()
    for r in got:
        want = urljoin(r.b if urlsplit(r.b).path else r.b + "/", r.p).split("#")[0]
        parts = urlsplit(want)
        web = parts.scheme in ("http", "https") and parts.netloc
        if web and not parts.path:
            want = f"{want.split('?')[0]}/" + (f"?{parts.query}" if parts.query else "")
        assert (r.u or "").lower() == (want.lower() if web else ""), (r.b, r.h)


def test_only_hosts_that_could_exist(table) -> None:
    good = ["https://h.test/", "http://[::1]:8/x", "https://u:p@h.test", "https://www.h"]
    bad = ["https:///x", "https://www./", "https://[::1/x", "ftp://h.test/", "https://a b/", "https://www.", "mailto:x@h.test", "https://", None]
    rows = table("u string", [(u,) for u in good + bad])
    assert [r.s for r in rows.select(F.coalesce(same_site(F.col("u"), F.col("u")), F.lit(False)).alias("s")).collect()] == [True] * len(good) + [False] * len(bad)


def test_a_page_has_one_identity(table) -> None:
    groups = [["https://www.K.test/a?b#c", "https://k.test:443/a?b", "HTTPS://k.test/a?b#"], ["https://k.test/a"], ["http://k.test/a", "http://www.k.test:80/a"], ["https://k.test:8443/a"], ["https://k.test", "https://k.test/"]]
    rows = table("g int, u string", [(i, u) for i, g in enumerate(groups) for u in g])
    keys = defaultdict(set)
    for r in rows.select("g", url_key(F.col("u")).alias("k")).collect():
        keys[r.g].add(r.k)
    assert all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(groups)
    assert rows.select(site_of(F.col("u")).alias("s")).distinct().count() == 3


def test_attribute_references(table) -> None:
    rng = random.Random(7)
    closed = ["&amp;", "&eacute;", "&#38;", "&#x2F;", "&zzz;"]
    values = ["".join(rng.choice([*closed, "/", "x", "=", "é", "?a=1"]) for _ in range(8)) for _ in range(50)]
    open_ = {"/?a&copy=1": "/?a&copy=1", "/&copy": "/©", "/&copyx": "/&copyx", "/&copy-": "/©-", "/&#38x": "/&x", "/&copyß": "/©ß", "plain": "plain"}
    rows = table("v string", [(v,) for v in [*values, *open_]])
    got = [r.u for r in rows.select(html_unescape_attr(F.col("v")).alias("u")).collect()]
    assert got == [unescape(v) for v in values] + list(open_.values())


# --- walks ---


def plain_walk(pages: dict[str, list[str | None]], root: str, depth: int) -> list[tuple]:
    out, seen, level = [], {root}, [root]
    for d in range(depth + 1):
        found = []
        for page in level:
            out.append((page, d, page in pages if d < depth else None))
            for to in pages.get(page, []) if d < depth else []:
                if to and urlsplit(to).netloc == urlsplit(root).netloc and to not in seen:
                    seen.add(to)
                    found.append(to)
        level = found
    return out


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 12), (3, 40)])
def test_walks_are_breadth_first(table, seed, width) -> None:
    rng = random.Random(seed)
    names = {s: [f"https://{s}.test/p{i}" for i in range(60)] for s in "ab"}
    pages = {}
    for s, own in names.items():
        for page in own:
            if rng.random() < 0.8:
                pages[page] = [rng.choice([*own, *own, "https://away.test/x"]) for _ in range(rng.randint(0, width))] or [None]
    rows = [(src, pos * rng.choice([1, 10**9]) if seed == 3 else pos, dst) for src, to in pages.items() for pos, dst in enumerate(to)]
    if seed == 3:  # positions far apart still order by number
        rows = sorted(rows)
        place = {}
        for src, pos, _ in rows:
            place.setdefault(src, []).append(pos)
        pages = {src: [d for _, d in sorted((p, d or "") for s, p, d in rows if s == src)] for src in pages}
        pages = {src: [d or None for d in to] for src, to in pages.items()}
    edges = table("src string, pos bigint, dst string", rows + rows[:5])
    roots = [names["a"][0], names["b"][0], "https://dead.test/"]
    got = sitegraph.discover(edges, table("root string", [(r,) for r in roots]), 4).orderBy("root", "ord").collect()
    for root in roots:
        mine = [(r.url, r.depth, r.read) for r in got if r.root == root]
        want = plain_walk(pages, root, 4)
        if seed == 3:
            assert sorted(mine, key=str) == sorted(want, key=str)
        else:
            assert mine == want


@pytest.mark.parametrize("cap", [1, 2, 7, 30, 1000])
def test_a_walk_that_stops_at_its_cap_lists_what_the_whole_walk_does(table, cap) -> None:
    rng = random.Random(cap)
    names = {s: [f"https://{s}.test/p{i:02}" for i in range(n)] for s, n in (("a", 60), ("b", 12), ("c", 3))}
    rows = [(src, pos, rng.choice(own)) for own in names.values() for src in own if rng.random() < 0.8 for pos in range(rng.randint(0, 3))]
    edges, roots = table("src string, pos bigint, dst string", rows), table("root string", [(own[0],) for own in names.values()])
    whole, cut = (sitegraph.discover(edges, roots, 5, c).collect() for c in (None, cap))
    for own in names.values():
        mine = [r for r in whole if r.root == own[0]]
        kept = [sum(r.depth <= d for r in mine) for d in range(6)]
        last = next((d for d, n in enumerate(kept) if n >= cap), 5)
        # the level that fills it is asked, so its misses count; nothing below it is read
        assert {tuple(r) for r in cut if r.root == own[0]} == {tuple(r) for r in mine if r.depth <= last}
    first = lambda walk: sorted(map(tuple, sitegraph.cap_urls(walk, cap).collect()))
    assert first(sitegraph.discover(edges, roots, 5, cap)) == first(sitegraph.discover(edges, roots, 5))


def test_numbers_sort_as_text(table) -> None:
    n = [0, 9, 10, 99, 100, 12_345_678, 10**17, 2**62]
    got = [r.s for r in table("n bigint", [(x,) for x in n]).select(sitegraph.sortable(F.col("n")).alias("s")).collect()]
    assert got == sorted(got) and len(set(got)) == len(n)


def test_a_map_says_how_it_was_made(table) -> None:
    walk = table("root string, url string, depth int, ord string, read boolean", [("R", f"R/{i:02d}", 1, f"{i:02d}", i % 3 != 0) for i in range(40)] + [("S", "S/", 0, "0", False)])
    sitemap = table("root string, ord bigint, url string", [("S", i, f"S/{i}") for i in range(12)])
    listing = sitegraph.choose_listing(walk, sitemap)
    assert {(r.root, r.from_sitemap): r.n for r in listing.groupBy("root", "from_sitemap").agg(F.count("*").alias("n")).collect()} == {("R", False): 40, ("S", True): 12}
    assert sitegraph.choose_listing(walk, sitemap, use_sitemap=False).count() == 41
    roots, dropped, budgets = table("root string", [("R",), ("S",), ("T",)]), table("root string, n bigint", [("R", 5)]), table("root string, hit_budget boolean", [("R", False), ("R", True)])
    got = {r.root: r for r in sitegraph.coverage(walk, listing, roots, dropped, budgets, 12, shown=3).collect()}
    assert (got["R"].pages_read, got["R"].pages_missed_count, got["R"].pages_missed, got["R"].budget_exhausted, got["R"].dropped_other_origin) == (26, 14, ["R/00", "R/03", "R/06"], True, 5)
    assert got["S"].sitemap and got["S"].max_urls_reached and got["T"].nothing_read and not got["S"].nothing_read
    assert {r.root: (r["count"], len(r.sample)) for r in sitegraph.map_summary(listing, 5).collect()} == {"R": (40, 5), "S": (12, 5)}
    frontier = sitegraph.crawl_frontier(listing, 7)
    assert {r.root: (r.requested, r.discovered, r.not_crawled) for r in sitegraph.frontier_counts(frontier).collect()} == {"R": (7, 40, 33), "S": (7, 12, 5)}
    assert sorted(r.url for r in frontier.filter("requested and root = 'R'").collect()) == [f"R/{i:02d}" for i in range(7)]
    assert sitegraph.crawl_frontier(listing, None).filter("requested").count() == 52
    assert sitegraph.cap_urls(listing, 4).count() == 8


def test_reports_and_recrawls(table) -> None:
    items = table("root string, n bigint, url string, status string, http_status int", [("R", i, f"u{i}", "ok" if i % 4 else "blocked", 200 if i % 4 else 403) for i in range(30)])
    r = sitegraph.crawl_report(items, 3).first()
    assert (r.requested, r.saved, r.statuses, r.not_ok_count) == (30, 22, {"blocked": 8, "ok": 22}, 8)
    assert [(x.url, x.http_status) for x in r.not_ok] == [("u0", 403), ("u4", 403), ("u8", 403)]
    again = sitegraph.recrawl_set(table("root string, n bigint, url string", [("R", 11, "b"), ("R", 2, "a")]), table("root string, ord bigint, url string", [("R", 0, "c")]))
    assert [x.url for x in again.orderBy("part", "ord").collect()] == ["a", "b", "c"]


# --- links and sitemaps ---


def test_links_of_a_page(table) -> None:
    html = '<a href="/one?a=1&amp;b=2">x</a><A class=q HREF=\'two\'>y</A><a href=three>z</a><!-- <a href="/no"> --><script>"<a href=/no>"</script><a name="n">n</a><a href="mailto:m@x.test">m</a>'
    found = links.extract_links(table("url string, final_url string, text string", [(u, u, h) for u, h in (("https://l.test/d/", html), ("https://e.test/", "<p>none</p>"))]))
    assert [(r.pos, r.href) for r in found.filter("pos is not null").orderBy("pos").collect()] == [(0, "/one?a=1&amp;b=2"), (1, "two"), (2, "three"), (3, "mailto:m@x.test")]
    assert found.filter("pos is null").count() == 1
    resolved = [r.dst for r in links.resolve_links(found).filter("pos is not null").orderBy("pos").collect()]
    assert resolved == ["https://l.test/one?a=1&b=2", "https://l.test/d/two", "https://l.test/d/three", None]


def test_sitemaps_list_a_sites_own_pages_once(table) -> None:
    entries = ["https://m.test/a", "https://www.m.test/a#x", "https://n.test/a", "/rel", "http://m.test/a", "https://m.test/b", "https://n.test/a", "https://o.test/"]
    listed = table("root string, ord bigint, url string", [("https://m.test/", i, u) for i, u in enumerate(entries)])
    assert [r.url for r in links.sitemap_urls(listed).orderBy("ord").collect()] == ["https://m.test/a", "https://m.test/b"]
    assert {r.root: r.n for r in links.dropped_other_origin(listed.select("root", "url")).collect()} == {"https://m.test/": 3}
    body = "<urlset><url><loc> https://m.test/?a=1&amp;b=2 </loc></url><url><loc>https://m.test/c</loc></url></urlset>"
    assert [r.url for r in links.sitemap_locs(table("root string, text string", [("R", body)])).orderBy("ord").collect()] == ["https://m.test/?a=1&b=2", "https://m.test/c"]
    assert {r.url for r in links.sitemap_candidates(table("root string", [("https://m.test/deep/x",)])).collect()} == {"https://m.test/sitemap.xml", "https://m.test/robots.txt"}


# --- manifests ---


@pytest.mark.parametrize("part", [1, 7, 20_000])
def test_manifests_round_trip_in_order(spark, table, tmp_path, part) -> None:
    rng = random.Random(part)
    n = 40 if part < 100 else 45_000
    order = rng.sample(range(10 * n), n)
    listing = table("root string, ord bigint, url string", [("R", o, f"https://r.test/{o}") for o in order] + [("Q", 3, "https://q.test/")])
    manifests.write_manifest(listing, str(tmp_path / "m"), part)
    back = manifests.read_manifest(spark, str(tmp_path / "m")).orderBy("root", "ord").collect()
    assert [r.url for r in back] == ["https://q.test/", *(f"https://r.test/{o}" for o in sorted(order))]
    with pytest.raises(Exception, match="exist"):
        manifests.write_manifest(listing, str(tmp_path / "m"), part)


def test_crawl_manifests_list_pages_then_the_rest(spark, table, tmp_path) -> None:
    schema = "root string, n bigint, url string, final_url string, file string, title string, status string, via string, words bigint, http_status int, error string"
    items = table(schema, [{"root": "R", "n": i, "url": f"p{i}"} for i in range(9)])
    left = table("root string, ord bigint, url string", [("R", i, f"l{i}") for i in range(5)] + [("S", 0, "only left")])
    manifests.write_crawl_manifest(items, left, str(tmp_path / "c"), 4)
    back = manifests.read_manifest(spark, str(tmp_path / "c")).orderBy("root", "ord").collect()
    assert [r.url for r in back] == [*(f"p{i}" for i in range(9)), *(f"l{i}" for i in range(5)), "only left"]


@pytest.mark.parametrize("doc", ["[]", '"x"', '{"root": 5, "urls": []}', '{"urls": "one"}', '{"urls": [1]}', '{"pages": ["u"]}', "{}", "{ torn"])
def test_other_documents_are_refused(spark, tmp_path, doc) -> None:
    (tmp_path / "x.json").write_text(doc + "\n")
    with pytest.raises(Exception, match="not a map or crawl manifest"):
        manifests.read_manifest(spark, str(tmp_path)).collect()


def test_sketches_of_crawls_unite_within_their_error(table) -> None:
    rng = random.Random(1)
    rows = [(f"https://{'ab'[i % 2]}.test/", f"https://o{rng.randrange(30_000 if i % 2 else 200)}.test/p#{i}", i % 5) for i in range(60_000)]
    rows += [("https://a.test/", "https://a.test/own", 1), ("https://a.test/", "mailto:x@y", 1)]
    found = table("root string, url string, crawl_id int", rows)
    sketches = links.dropped_sketches(found, bits=12)
    exact = {r.root: r.n for r in links.dropped_other_origin(found.select("root", "url")).collect()}
    got = {r.root: r.n for r in links.dropped_over_crawls(sketches).collect()}
    assert exact["https://a.test/"] == got["https://a.test/"] == 200
    assert abs(got["https://b.test/"] - exact["https://b.test/"]) < 3 * 1.04 / 64 * exact["https://b.test/"]
    assert sketches.count() == 10


# --- attempts ---

LOG = "url string, attempt_no int, via string, status int, content_type string, kind string, text string, error string, threw boolean"
FULL = "<body><article>" + " ".join(f"w{i}" for i in range(90)) + "</article>"
BODIES = {"ok": FULL, "shell": "<body><p>few</p>", "challenge": FULL + "<i id='challenge-running'></i>".replace("'", '"')}


def attempt(url: str, no: int, via: str, what: str) -> dict:
    if what in BODIES:
        return {"url": url, "attempt_no": no, "via": via, "status": 200, "content_type": "text/html", "kind": "text", "text": BODIES[what]}
    return {"url": url, "attempt_no": no, "via": via, "status": 0, "kind": "error", "error": {"threw": "fetch failed", "lost": "CDP session detached: x"}.get(what, what), "threw": what == "threw"}


def random_log(seed: int) -> dict[str, list[tuple[str, str]]]:
    rng = random.Random(seed)
    out = {}
    for h in range(12):
        for p in range(4):
            tries = [("fetch", rng.choice(["ok", "shell", "challenge", "timeout", "threw"])) for _ in range(rng.randint(1, 2))]
            tries += [("tab", rng.choice(["ok", "shell", "lost", "no route"])) for _ in range(rng.choice([0, 0, 1, 2]))]
            out[f"https://h{h}.test/{p}"] = tries
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_attempts_resolve_like_a_plain_reading(table, seed) -> None:
    log = random_log(seed)
    rows = table(LOG, [attempt(u, i + 1, via, what) for u, tries in log.items() for i, (via, what) in enumerate(tries)])
    last = {u: {via: what for via, what in tries} for u, tries in log.items()}
    failed = lambda w: w in ("lost", "no route")
    host = lambda u: urlsplit(u).netloc
    tabs = defaultdict(list)
    for u, x in last.items():
        if "tab" in x:
            tabs[host(u)].append((u, x["tab"]))
    assert {r.url for r in attempts.retry_set(rows).collect()} == {u for u, t in log.items() if [x for x in t if x[0] == "fetch"] == [("fetch", "timeout")]}
    assert {r.url for r in attempts.detached_retry(rows).collect()} == {u for u, t in log.items() if [x for x in t if x[0] == "tab"] == [("tab", "lost")]}
    want = set()
    for u, x in last.items():
        here = tabs[host(u)]
        if "tab" in x or any(failed(w) for _, w in here):
            continue
        thrown = sorted(v for v, y in last.items() if host(v) == host(u) and "tab" not in y and y["fetch"] == "threw")
        if x["fetch"] in ("shell", "challenge") or x["fetch"] == "threw" and (here or u == thrown[0]):
            want.add(u)
    assert {r.url for r in attempts.escalation_set(rows).collect()} == want
    said = {h: min((u, w) for u, w in t if failed(w))[1] for h, t in tabs.items() if any(failed(w) for _, w in t)}
    words = {"lost": "CDP session detached: x", "threw": "fetch failed", "shell": "only 1 words extracted", "challenge": "a bot check answered instead of the page", "ok": None}
    tell = lambda w: words.get(w, w)
    for r in attempts.resolve_attempts(rows).collect():
        x = last[r.url]
        fetch, tab = x["fetch"], x.get("tab")
        if tab and not failed(tab):
            error = None if tab == "ok" else "; in a tab: ".join([tell(fetch), tell(tab)]) if fetch == "threw" else tell(tab)
            assert (r.via, r.status, r.error) == ("tab", "ok" if tab == "ok" else "shell_escalated", error)
        else:
            base = tell(fetch)
            error = "; ".join(e for e in (base, f"in a tab: {tell(tab)}") if e) if tab else f"{base}; in a tab: {tell(said[host(r.url)])}" if fetch == "threw" and host(r.url) in said else base
            assert (r.via, r.status, r.error) == ("fetch", fetch if fetch in BODIES else "error", error)
        assert r.attempts == len(log[r.url])
    narrow = {(r.url, r.status, r.http_status) for r in attempts.resolved_statuses(rows).collect()}
    assert narrow == {(r.url, r.status, r.http_status) for r in attempts.resolve_attempts(rows).collect()}


@pytest.mark.parametrize("order", [1, -1])
def test_a_url_listed_twice_counts_as_first_listed(table, order) -> None:
    made = [(place, attempt(u, no, via, what)) for u in "ABC" for place, tries in ((7, [("fetch", "challenge")]), (3, [("fetch", "ok"), ("tab", "lost")]), (9, [("fetch", "shell"), ("tab", "ok")]))
            for no, (via, what) in enumerate(tries, 1)]
    rows = table(LOG + ", page_id bigint", [{**a, "url": f"https://{a['url']}.test/", "page_id": place} for place, a in made[::order]]).repartition(4)
    assert [(r.status, r.via, r.error, r.attempts) for r in attempts.resolve_attempts(rows, place="page_id").collect()] == [("ok", "fetch", "in a tab: CDP session detached: x", 5)] * 3
    assert [(r.status, r.http_status, r.n) for r in attempts.resolved_statuses(rows, place="page_id", n=F.min("page_id")).collect()] == [("ok", 200, 3)] * 3


def test_batches(table) -> None:
    listing = table("root string, ord bigint, url string", [(root, i, f"u{i}") for root in ("R", None) for i in range(10)])
    got = defaultdict(list)
    for r in attempts.assign_batches(listing, 4).orderBy("ord").collect():
        got[r.root].append(r.batch)
    assert got == {"R": [0] * 4 + [1] * 4 + [2] * 2, None: [0] * 4 + [1] * 4 + [2] * 2}
