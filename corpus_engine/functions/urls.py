"""URL functions.

URLs are taken apart with one regular expression that follows the browser
definition of a URL (``parse_url`` follows ``java.net.URI``, which rejects many
links that browsers accept). A URL without a host is invalid. Arguments are
bound with ``let``: functions nest, and plain expressions would multiply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.collections import let
from corpus_engine.functions.text import WS

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://"
_HOST = r"(\[[0-9a-fA-F:.]+\]|[^\s/?#:@\[\]<>^|%\\]+)"
_PARTS = rf"(?s){_SCHEME}((?:[^/?#@]*@)?){_HOST}(:[0-9]*)?(?=[/?#]|\z)([^?#]*)(\?[^#]*)?(#.*)?\z"

# Tracking parameters that are dropped.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")

# Extensions and patterns that are not crawled.
SKIP_EXTENSIONS = (
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".tar", ".gz", ".rar",
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv",
    ".css", ".js", ".json", ".xml", ".rss",
)
SKIP_PATTERNS = (
    "/wp-admin", "/wp-login", "/feed", "/rss",
    "/login", "/signin", "/signup", "/register",
    "/account", "/cart", "/checkout", "/admin",
    "/search?", "/search/",
    "/calendar/", "/filter/", "/facet/",
    "javascript:", "mailto:", "tel:", "#",
)

# Hosts that are never fetched.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "metadata.google.internal")
BLOCKED_HOST_PATTERN = (
    r"\.local\z|\.internal\z|^10\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^169\.254\."
)


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, _PARTS, group)


def host(u: Column) -> Column:
    """Lower-case host name, null for an invalid URL."""
    return F.lower(F.get(F.regexp_extract_all(u, F.lit(_PARTS), F.lit(3)), 0))


def pathname(u: Column) -> Column:
    """Serialised path, null for an invalid URL."""
    return _clean_path(F.get(F.regexp_extract_all(u, F.lit(_PARTS), F.lit(5)), 0))


def with_scheme(u: Column) -> Column:
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def _percent_encode(text: Column) -> Column:
    """Encode what a browser encodes in paths and queries; leave the rest."""
    unsafe = r"[^\x21-\x7E]|[\"<>`{}]"

    def encode(c: Column) -> Column:
        encoded = F.array_join(
            F.transform(
                F.split(c, ""),
                lambda ch: F.when(ch == " ", F.lit("%20"))
                .when(ch.rlike(unsafe), F.url_encode(ch))
                .otherwise(ch),
            ),
            "",
        )
        return F.when(c.rlike(unsafe), encoded).otherwise(c)

    return let(text, encode)


def _fold_dots(path: Column) -> Column:
    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(kept, "/"), tail)

    return F.when(
        path.rlike(r"/\.\.?(/|\z)"),
        F.regexp_replace(let(F.split(path, "/"), fold), "^(?!/)", "/"),
    ).otherwise(path)


def _clean_path(path: Column) -> Column:
    return let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(_percent_encode(_fold_dots(p))))


def _origin(u: Column) -> Column:
    scheme = F.lower(_part(u, 1))
    port = _part(u, 4)
    default = (
        (port == ":")
        | ((scheme == "http") & (port == ":80"))
        | ((scheme == "https") & (port == ":443"))
    )
    return F.concat(
        scheme, F.lit("://"), _part(u, 2), host(u), F.when(default, F.lit("")).otherwise(port)
    )


def serialize_url(u: Column) -> Column:
    """The URL as a browser writes it back; null when it is invalid."""

    def build(x: Column) -> Column:
        whole = F.concat(
            _origin(x),
            _clean_path(_part(x, 5)),
            _percent_encode(_part(x, 6)),
            _percent_encode(_part(x, 7)),
        )
        return F.when(host(x).isNotNull(), whole)

    return let(u, build)


def _form_value(c: Column) -> Column:
    return F.url_encode(F.coalesce(F.try_url_decode(c), c))


def _clean_query(query: Column) -> Column:
    """The query without tracking parameters, written as a form."""

    def pair(p: Column) -> Column:
        cut = F.split(p, "=", 2)
        return F.struct(
            F.get(cut, 0).alias("name"), F.coalesce(F.get(cut, 1), F.lit("")).alias("value")
        )

    pairs = F.filter(
        F.transform(
            F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda p: p != ""), pair
        ),
        lambda p: ~F.coalesce(F.try_url_decode(p["name"]), p["name"]).isin(*TRACKING_PARAMS),
    )
    text = F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(_form_value(p["name"]), F.lit("="), _form_value(p["value"])),
        ),
        "&",
    )
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


def normalize_url(u: Column) -> Column:
    """Canonical form: no fragment, no tracking parameters, no final slash."""

    def build(full: Column) -> Column:
        query = _part(full, 6)
        url = F.concat(
            _origin(full),
            _clean_path(_part(full, 5)),
            F.when(query == "", F.lit("")).otherwise(_clean_query(query)),
        )
        return F.when(host(full).isNotNull(), F.regexp_replace(url, r"/\z", ""))

    return let(u, lambda x: F.coalesce(let(with_scheme(F.btrim(x, F.lit(" \t\r\n"))), build), x))


def is_same_domain(u: Column, base: Column) -> Column:
    return F.coalesce(host(u) == host(base), F.lit(False))


def is_valid_url(u: Column) -> Column:
    full = with_scheme(u)
    name = host(full)
    bad = name.isin(*BLOCKED_HOSTS) | name.rlike(BLOCKED_HOST_PATTERN)
    return F.coalesce(F.lower(_part(full, 1)).isin("http", "https") & ~bad, F.lit(False))


def extract_domain(u: Column) -> Column:
    return F.coalesce(F.regexp_replace(host(with_scheme(u)), r"^www\.", ""), u)


def should_skip_url(u: Column, allow_pdf: bool = False) -> Column:
    extensions = SKIP_EXTENSIONS if allow_pdf else (*SKIP_EXTENSIONS, ".pdf")
    ends = "|".join(e.replace(".", r"\.") for e in extensions)
    inside = "|".join(p.replace("?", r"\?") for p in SKIP_PATTERNS)
    return F.lower(u).rlike(rf"(?s)(?:{ends})\z|{inside}")


def is_in_domain_scope(u: Column, base: Column, allowed: Column | None = None) -> Column:
    """Same host, or below one of the ``allowed`` domains (array column)."""
    same = host(u) == host(base)
    if allowed is not None:
        bare = F.regexp_replace(host(u), r"^www\.", "")
        below = F.exists(
            allowed,
            lambda d: (bare == F.regexp_replace(d, r"^www\.", ""))
            | bare.endswith(F.concat(F.lit("."), F.regexp_replace(d, r"^www\.", ""))),
        )
        same = same | (host(base).isNotNull() & below)
    return F.coalesce(same, F.lit(False))


def is_pdf_url(u: Column) -> Column:
    return F.lower(u).endswith(".pdf")


def glob_to_regex(glob: str) -> str:
    """Path glob as a regex anchored at the start only."""
    return "^" + glob.replace("*", ".*").replace("?", ".")


def matches_path_patterns(u: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(True)
    pattern = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return F.coalesce(pathname(u).rlike(pattern), F.lit(False))


def path_allowed(u: Column, include: list[str], exclude: list[str]) -> Column:
    ok = matches_path_patterns(u, include)
    return ok & ~matches_path_patterns(u, exclude) if exclude else ok


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of a link on page ``base``; null when it is invalid."""

    def build(pair: Column) -> Column:
        h, b = pair["h"], pair["b"]
        origin = _origin(b)
        base_path = F.when(_part(b, 5) == "", F.lit("/")).otherwise(_part(b, 5))
        web = h.rlike(r"^(?i)https?:")
        absolute = (
            F.when(web, h)
            .when(h.startswith("//"), F.concat(F.lower(_part(b, 1)), F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, base_path, h))
            .when(h.startswith("#"), F.concat(origin, base_path, _part(b, 6), h))
            .otherwise(F.concat(origin, F.regexp_replace(base_path, r"[^/]*\z", ""), h))
        )
        other = h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~web
        return (
            F.when(F.coalesce(h, F.lit("")) == "", None)
            .when(other, h)
            .otherwise(serialize_url(absolute))
        )

    return let(F.struct(F.btrim(href, F.lit(" \t\r\n")).alias("h"), base.alias("b")), build)


def title_from_url(u: Column) -> Column:
    name = F.element_at(F.split(pathname(u), "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf\z", ""), "[-_]", " ")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("PDF Document"))


def slugify(name: Column) -> Column:
    c = F.regexp_replace(F.lower(name), rf"(?!{WS})[^a-z0-9-]", "")
    c = F.regexp_replace(c, f"{WS}+", "-")
    c = F.regexp_replace(c, "-+", "-")
    return F.left(F.regexp_replace(c, r"^-|-\z", ""), F.lit(60))


def is_valid_custom_domain(d: Column) -> Column:
    return d.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9-]*\.[a-zA-Z]{2,}\z")
