"""Text, hash and label functions.

White space follows the ECMAScript definition, which differs from both Java's
``\\s`` and SQL ``trim``; ``length`` counts code points (UTF-16 units differ only
on astral characters).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.collections import distinct_in_order, let

# The ECMAScript white space and line terminator characters.
WS_CHARS = (
    "\t\n\x0b\f\r          "
    "        　﻿"
)
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

_WIDE_WS = (
    r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
_WIDE_WS_PREFIXES = (
    b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf",
)

# Boilerplate openings, matched at the start of lower-cased text.
BOILERPLATE_STARTS = (
    rf"(copyright|©){WS}",
    r"all rights reserved",
    r"terms (of|and) (service|use|conditions)",
    r"privacy policy",
    r"cookie (policy|notice|consent)",
    r"(follow|connect with) us on",
    r"(subscribe|sign up) (to|for) (our|the) newsletter",
    r"(back to top|scroll to top)",
    r"(skip to|jump to) (main )?content",
    rf"(home|about|contact|blog|faq|support|careers|press){WS}*\z",
)
MIN_CHUNK_CHARS = 80

# Locale prefix -> text search configuration.
FTS_CONFIGS = (
    ("en", "english"),
    ("ko", "simple"),
    ("ja", "simple"),
    ("zh", "simple"),
    ("de", "german"),
    ("fr", "french"),
    ("es", "spanish"),
    ("pt", "portuguese"),
    ("it", "italian"),
    ("nl", "dutch"),
    ("ru", "russian"),
    ("sv", "swedish"),
    ("da", "danish"),
    ("fi", "finnish"),
    ("no", "norwegian"),
    ("tr", "turkish"),
    ("hu", "hungarian"),
    ("ro", "romanian"),
)

# Words that ask for fresh information.
FRESHNESS_WORDS = (
    "latest", "recent", "new", "updated", "current", "today",
    "this week", "this month", "changed", "announced",
    "pricing", "price change", "launch", "release",
    "최근", "최신", "새로운", "업데이트", "변경", "발표",
)

# User agent tokens.
BROWSER_TOKENS = ("mozilla", "chrome", "safari", "firefox", "edge", "opera")
BOT_TOKENS = (
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python-requests",
    "httpie", "go-http-client", "java/", "libwww",
)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def plain_ws(c: Column) -> Column:
    """Non-ASCII white space as plain spaces.

    Byte probes for the few UTF-8 prefixes cost far less than a regular
    expression with all white space characters, and almost no text has any.
    """
    raw = c.cast("binary")
    present = reduce(
        lambda a, b: a | b, [F.contains(raw, F.lit(p)) for p in _WIDE_WS_PREFIXES]
    )
    return F.when(present, F.regexp_replace(c, _WIDE_WS, " ")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.btrim(F.regexp_replace(plain_ws(c), r"\s+", " "), F.lit(" "))


def or_else(*cs: Column) -> Column:
    """First string that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized_hash(c: Column) -> Column:
    return F.md5(F.lower(collapse_ws(c)))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(4))


def snippet(c: Column, limit: int = 200) -> Column:
    """The first characters with collapsed white space, marked when cut.

    A head that is long enough decides alone; only odd texts are read whole.
    """
    head = collapse_ws(F.left(c, F.lit(5 * limit)))
    clean = F.when(F.length(head) > limit, head).otherwise(collapse_ws(c))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.left(clean, F.lit(limit)), F.lit("..."))
    )


def embedding_text(content: Column, site: Column, title: Column, url: Column | None = None) -> Column:
    """Chunk text without Markdown marks, led by ``site - title:``."""
    clean = content
    for pattern, keep in (
        (rf"#{{1,6}}{WS}", ""),
        (r"\*\*(.*?)\*\*", "$1"),
        (r"\*(.*?)\*", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"`([^`]+)`", "$1"),
    ):
        clean = F.regexp_replace(clean, pattern, keep)
    name = title if url is None else or_else(title, url)
    return F.concat(site, F.lit(" - "), name, F.lit(": "), js_trim(clean))


def words(c: Column) -> Column:
    """Lower-case words between white space."""
    none = F.array().cast("array<string>")
    clean = F.btrim(F.lower(plain_ws(c)), F.lit(" \t\n\x0b\f\r"))
    return let(clean, lambda s: F.when(s == "", none).otherwise(F.split(s, r"\s+")))


def shingles(c: Column, size: int = 3) -> Column:
    """Distinct word n-grams; texts with fewer words have none."""
    return F.array_distinct(shingle_list(words(c), size))


def shingle_list(w: Column, size: int = 3) -> Column:
    """All n-grams of a word array, in order."""

    def build(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - (size - 1), F.lit(0))

        def join(first: Column, i: Column) -> Column:
            parts = [first]
            for k in range(1, size):
                parts += [F.lit(" "), F.get(ws, i + k)]
            return F.concat(*parts)

        return F.transform(F.slice(ws, F.lit(1), n), join)

    return let(w, build)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two distinct arrays; two empty sets are equal."""
    def share(sizes: Column) -> Column:
        union = sizes["a"] + sizes["b"] - sizes["both"]
        return F.when(union == 0, F.lit(1.0)).otherwise(sizes["both"] / union)

    def sizes(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        return let(F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), both.alias("both")), share)

    return let(F.struct(a.alias("a"), b.alias("b")), sizes)


def is_likely_boilerplate(c: Column) -> Column:
    low = js_trim(F.lower(c))
    starts = "^(?:" + "|".join(BOILERPLATE_STARTS) + ")"
    return (F.length(low) < MIN_CHUNK_CHARS) | low.rlike(starts)


def fts_language(lang: Column) -> Column:
    code = F.lower(F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("en")))
    out = F.when(F.lit(False), F.lit(""))
    for prefix, config in FTS_CONFIGS:
        out = out.when(code.startswith(prefix), F.lit(config))
    return out.otherwise(F.lit("simple"))


def sanitize_value(c: Column) -> Column:
    return js_trim(F.left(F.translate(c, '"\\\n\r', "    "), F.lit(200)))


def needs_fresh_data(c: Column) -> Column:
    return F.lower(c).rlike("|".join(FRESHNESS_WORDS))


def is_likely_bot(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(low == "", F.lit(True))
        .when(low.rlike("|".join(BROWSER_TOKENS)), F.lit(False))
        .otherwise(low.rlike("|".join(BOT_TOKENS)))
    )


def client_ip(forwarded: Column, real_ip: Column) -> Column:
    shape = r"^[\d.:a-fA-F]+\z"
    first = js_trim(F.element_at(F.split(forwarded, ","), 1))
    return F.coalesce(
        F.when(first.rlike(shape), first),
        F.when(real_ip.rlike(shape), real_ip),
        F.lit("127.0.0.1"),
    )


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")


def confidence_percent(c: Column) -> Column:
    """Half-up rounding, as browsers do it."""
    return F.floor(c * 100 + F.lit(0.5))


def model_label(c: Column) -> Column:
    """The name without its first ``gemini-`` and first ``-preview``."""
    out = c
    for part in ("gemini-", "-preview"):
        at = F.instr(out, part)
        out = F.when(at > 0, F.concat(F.left(out, at - 1), F.substring(out, at + len(part), F.length(out)))).otherwise(out)
    return out


def conversation_title(c: Column) -> Column:
    return F.left(c, F.lit(100))


_ANSWER = (
    "answer string, citations array<struct<url: string, title: string, excerpt: string>>, "
    "confidence double, answered_from_sources_only boolean, needs_recrawl boolean"
)


def parse_structured_answer(raw: Column) -> Column:
    """Typed answer; text that is not JSON becomes the answer itself."""
    variant = F.try_parse_json(raw)
    kind = F.schema_of_variant(variant)
    is_object = kind.startswith("OBJECT")
    p = F.from_json(raw, _ANSWER)
    return F.struct(
        F.when(variant.isNull(), raw)
        .when(is_object, F.coalesce(p["answer"], F.lit("")))
        .otherwise(F.lit(""))
        .alias("answer"),
        F.coalesce(
            F.when(is_object, p["citations"]),
            F.from_json(F.lit("[]"), "array<struct<url: string, title: string, excerpt: string>>"),
        ).alias("citations"),
        F.coalesce(
            F.when(is_object & _is_number(variant, "$.confidence"), p["confidence"]),
            F.lit(0.5),
        ).alias("confidence"),
        F.coalesce(F.when(is_object, p["answered_from_sources_only"]), F.lit(True)).alias(
            "answered_from_sources_only"
        ),
        F.coalesce(F.when(is_object, p["needs_recrawl"]), F.lit(False)).alias("needs_recrawl"),
    )


def _is_number(variant: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def extract_prop(payload: Column, key: str, kind: str = "string") -> Column:
    value = F.get_json_object(payload, f"$.{key}")
    return value if kind == "string" else value.try_cast(kind)


def dedupe_lines(c: Column) -> Column:
    """First occurrence of each trimmed line; blank lines always stay."""
    lines = F.split(c, "\n")
    return F.array_join(distinct_in_order(lines, js_trim, keep_blank=True), "\n")
