"""URL parts, identity, names and resolution, all as column expressions.

The parts are cut with one fixed pattern instead of a URI parser: links found on the web are often not valid URIs, and a
link that cannot be read must cost only itself.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
BASE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
# a host that could exist: not empty, not ``www.`` alone, no stray bracket or blank in it
WEB_URL = (r"(?i)^https?://(?:[^/?#]*@)?(?!www\.?(?:[:/?#]|$))(?:[^\s\[\]<>\\^`{|}%\"':@/?#]+|\[[0-9a-f:.]+\])"
           r"(?::[0-9]*)?(?:[/?#]|$)")
#: Longest stem of a saved file's name.
SLUG_CHARS = 120

# The functions nest one pattern in the next and name their input once, so that no part is computed twice.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def authority_host(url: Column) -> Column:
    """The host, without credentials and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    """The host without one leading ``www.``."""
    return F.regexp_replace(authority_host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL, 3)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#[\s\S]*$", "")


def valid_web_url(url: Column) -> Column:
    """An http(s) URL whose host could exist: ``www.`` alone, an open bracket or no host at all could not."""
    return F.coalesce(url.rlike(WEB_URL), F.lit(False))


def _plain_port(base: Column) -> Column:
    """Scheme, host and port without the port that is the scheme's own."""
    own = r"^(https://(?:\[[^\]]*\]|[^:]*)):443$|^(http://(?:\[[^\]]*\]|[^:]*)):80$"
    return F.regexp_replace(base, own, "$1$2")


def origin(url: Column) -> Column:
    base = F.lower(F.regexp_extract(url, BASE, 1))
    return _plain_port(F.regexp_replace(base, r"^([a-z][a-z0-9+.-]*://)(?:.*@)?", "$1"))


def site_of(url: Column) -> Column:
    """What makes two URLs one site: scheme, host without ``www.``, port."""
    base = F.lower(F.regexp_extract(url, BASE, 1))
    return _plain_port(F.regexp_replace(base, r"^([a-z][a-z0-9+.-]*://)(?:.*@)?(?:www\.)?", "$1"))


def same_site(a: Column, b: Column) -> Column:
    return valid_web_url(a) & valid_web_url(b) & (site_of(a) == site_of(b))


def url_key(url: Column) -> Column:
    """A page's identity: its site, path and query. The fragment and ``www.`` name no other page."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(site_of(url), F.regexp_replace(rest, r"^(?!/)", "/"))


def url_slug(url: Column, max_chars: int = SLUG_CHARS) -> Column:
    """A readable, stable file name: ``host-path.md``."""
    words = F.regexp_replace(F.concat(authority_host(url), F.lit("-"), path(url)), r"[^\p{L}\p{N}._-]+", "-")
    joined = F.regexp_replace(words, r"-{2,}", "-")
    stem = F.regexp_replace(F.substring(joined, 1, max_chars), r"^-+|-+$", "")
    return F.concat(stem, F.lit(".md"))


def _without_dots(path_: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken (RFC 3986, 5.2.4)."""
    def walked(p: Column) -> Column:
        steps = F.split(F.regexp_replace(p, r"/(\.{1,2})$", "/$1/"), "/")
        return F.aggregate(
            steps, F.array().cast("array<string>"),
            lambda done, step: F.when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
            .when(step == ".", done).otherwise(F.concat(done, F.array(step))),
            lambda done: F.array_join(done, "/"))

    return let(path_, lambda p: F.when(p.contains("/."), walked(p)).otherwise(p))


def resolve_href(base: Column, href: Column) -> Column:
    """The absolute URL an href names on the page ``base``, without its fragment; null where it names no web page.

    Follows RFC 3986 section 5.2 for references with a scheme, ``//host``, ``/path``, ``?query``, ``#fragment`` and
    relative paths.
    """
    # as a browser reads it: line breaks and tabs go first, then control characters and blanks around it; a blank within is written out
    bare = F.regexp_replace(F.regexp_replace(href, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    target = without_fragment(F.replace(bare, F.lit(" "), F.lit("%20")))
    root = F.regexp_extract(base, BASE, 1)
    # the base's path up to its last slash, or all of it
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^?#]*)?/|)", 1), r"^$", "/")
    page = F.regexp_replace(path(base), r"^$", "/")

    def with_path(t: Column, prefix: Column) -> Column:
        whole = F.concat(prefix, F.regexp_extract(t, r"^([^?]*)", 1))
        return F.concat(root, _without_dots(whole), F.regexp_extract(t, r"(\?[\s\S]*)$", 1))

    def absolute(t: Column) -> Column:
        return (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
                .when(t.startswith("//"), F.concat(F.regexp_extract(base, URL, 1), F.lit(":"), t))
                .when(t.startswith("/"), with_path(t, F.lit("")))
                .when(t == "", without_fragment(base))
                .when(t.startswith("?"), F.concat(root, page, t))
                .otherwise(with_path(t, folder)))

    full = F.regexp_replace(let(target, absolute), r"^([A-Za-z]+://[^/?#]*)$", "$1/")
    return let(full, lambda u: F.when(valid_web_url(u), u))
