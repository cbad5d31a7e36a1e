"""Column functions: each takes and returns ``Column`` and stays in the JVM unless its docstring says otherwise."""
from pagewright.functions.bodies import (body_kind, header_charset, html_sniff, is_challenge, not_utf8,
                                         replacement_chars, surviving_non_ascii)
from pagewright.functions.markup import html_title, html_to_markdown, html_unescape_attr, main_text
from pagewright.functions.text import frontmatter, json_string, preview, run_label, word_count
from pagewright.functions.urls import (authority_host, bare_host, origin, resolve_href, same_site, site_of, url_key, url_slug,
                                       valid_web_url, without_fragment)

__all__ = [
    "authority_host", "bare_host", "body_kind", "frontmatter", "header_charset", "html_sniff", "html_title", "html_to_markdown",
    "html_unescape_attr", "is_challenge", "json_string", "main_text", "not_utf8", "origin", "preview", "replacement_chars",
    "resolve_href", "run_label", "same_site", "site_of", "surviving_non_ascii", "url_key", "url_slug", "valid_web_url",
    "without_fragment", "word_count",
]
