"""SQL fragments that several counterpart queries share."""

from __future__ import annotations

from corpus_engine.functions.text import WS, WS_CHARS
from corpus_engine.functions.urls import TRACKING_PARAMS


def trim(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def norm_hash(x: str) -> str:
    return f"md5({collapse(f'lower({x})')})"


def snippet(x: str, limit: int = 200) -> str:
    c = collapse(x)
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE left({c}, {limit}) || '...' END"


def tokens(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS BIGINT)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{WS}+'), lambda w: w <> '')"


def shingles(w: str) -> str:
    """Distinct word triples of a word list."""
    return (
        f"CASE WHEN len({w}) < 3 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform("
        f"range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])) END"
    )


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1))"


def percent_encode(x: str) -> str:
    bad = r"[^\x21-\x7E]|[\"<>`{}]".replace('\\"', '"')
    return (
        f"CASE WHEN regexp_matches({x}, '{bad}') THEN array_to_string(list_transform("
        f"string_split({x}, ''), lambda ch: CASE WHEN regexp_matches(ch, '{bad}') "
        f"THEN url_encode(ch) ELSE ch END), '') ELSE {x} END"
    )


def normalize_url(u: str) -> str:
    """Normal form of an absolute URL without user, port or dot segments."""
    names = "|".join(TRACKING_PARAMS)
    base = f"regexp_replace({u}, '#.*$', '')"
    path = percent_encode(f"regexp_extract({base}, '^[a-z]+://[^/?]*([^?]*)', 1)")
    query = f"regexp_extract({base}, '[?](.*)$', 1)"
    kept = (
        f"array_to_string(list_filter(string_split({query}, '&'), "
        f"lambda p: p <> '' AND NOT regexp_matches(p, '^({names})(=|$)')), '&')"
    )
    scheme = f"regexp_extract({base}, '^([a-z]+://)', 1)"
    return (
        f"regexp_replace({scheme} || {host(base)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END "
        f"|| CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END, '/$', '')"
    )


def boilerplate(x: str) -> str:
    low = trim(f"lower({x})")
    from corpus_engine.functions.text import BOILERPLATE_STARTS

    return f"(length({low}) < 80 OR regexp_matches({low}, '^(?:{'|'.join(BOILERPLATE_STARTS)})'))"


def boundary(x: str, pos: int = 2000) -> str:
    found = f"length(regexp_extract(left({x}, {pos}), '^(.*[.!?]){WS}', 1, 's'))"
    return f"CASE WHEN {found} > {pos} * 0.7 THEN {found} ELSE {pos} END"


def plain_chunks(source: str, keep: str) -> str:
    """Chunks of single-paragraph texts without headings or questions."""
    return f"""
      SELECT {keep}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS chunk_index,
             {trim('piece')} AS content, {snippet('piece')} AS snippet,
             {tokens(trim('piece'))} AS token_count
      FROM (
        SELECT *, 1 AS part, CASE WHEN length(text) <= 2000 THEN text
                 ELSE {trim(f'left(text, {boundary("text")})')} END AS piece
        FROM {source}
        UNION ALL
        SELECT *, 2 AS part, {trim(f'substr(text, {boundary("text")} + 1)')} AS piece
        FROM {source} WHERE length(text) > 2000
      ) WHERE length({trim('piece')}) >= 80"""
