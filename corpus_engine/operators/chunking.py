"""Heading-, FAQ- and size-aware chunking.

A page is one row and stays one row until its chunks are complete: sections,
question pairs and size cuts are array expressions, and one ``posexplode`` at
the end numbers the chunks. No shuffle is needed, whatever the page sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.collections import explode_once, let
from corpus_engine.functions.text import (
    MIN_CHUNK_CHARS,
    WS,
    estimate_tokens,
    is_likely_boilerplate,
    js_trim,
    snippet,
)

# Chunk size and overlap in characters.
TARGET_CHARS = 2000
OVERLAP_CHARS = 200

_LINE_WS = WS.replace(r"\t\n\x0B", r"\t\x0B")
_LINE_CHAR = r"[^\n\r\x{2028}\x{2029}]"
_HEADING = rf"(#{{2,6}}){_LINE_WS}+({_LINE_CHAR}+)"
_BEFORE_HEADING = rf"(?dm)^(?={_HEADING}$)"
_HEADING_LINE = rf"(?d)^{_HEADING}(?:\n|\z)"

_MARKED_PAIR = (
    rf"(?i)(?:^|\n){WS}*Q:{WS}*({_LINE_CHAR}+?)"
    rf"(?:\n{WS}*A:{WS}*((?s:.)+?))?(?=\n{WS}*Q:|{WS}*\z)"
)
# a question line has 16 characters or more once trimmed
_QUESTION_LINE = rf"{_LINE_WS}*(?!{WS})[^\n][^\n]{{14,}}\?{_LINE_WS}*"
_BEFORE_QUESTION = rf"(?dm)^(?={_QUESTION_LINE}$)"

_NO_STRINGS = "array<string>"


def sentence_boundary(text: Column, pos: int) -> Column:
    """End of the last sentence within ``pos`` characters, if in the last 30 %."""
    found = F.length(F.regexp_extract(F.left(text, F.lit(pos)), rf"(?s)^(.*[.!?]){WS}", 1))
    return let(found, lambda n: F.when(n > pos * 0.7, n).otherwise(F.lit(pos)))


def chunk_prefix(title: Column, path: Column) -> Column:
    """``[title > path]`` without blank parts; empty when both are blank."""
    inner = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(path, F.lit("")))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def sections(text: Column) -> Column:
    """Array of ``(heading_path, content)`` in document order.

    The text is split in front of each heading line; the breadcrumb of a section
    is the stack of headings that are still open, folded over the headings only.
    """

    def parts(pieces: Column) -> Column:
        return F.transform(
            pieces,
            lambda p, i: F.struct(
                F.length(F.regexp_extract(p, _HEADING_LINE, 1)).alias("level"),
                js_trim(F.regexp_extract(p, _HEADING_LINE, 2)).alias("title"),
                _strip_newline(
                    F.when(p.rlike(_HEADING_LINE), F.regexp_replace(p, r"^[^\n]*\n?", "")).otherwise(p),
                    i < F.size(pieces) - 1,
                ).alias("content"),
            ),
        )

    def with_paths(ps: Column) -> Column:
        start = F.struct(
            F.array().cast("array<struct<level: int, title: string>>").alias("open"),
            F.array().cast(_NO_STRINGS).alias("paths"),
        )

        def step(acc: Column, p: Column) -> Column:
            kept = F.when(p["level"] == 0, acc["open"]).otherwise(
                F.concat(
                    F.filter(acc["open"], lambda h: h["level"] < p["level"]),
                    F.array(F.struct(p["level"].alias("level"), p["title"].alias("title"))),
                )
            )
            return let(
                kept,
                lambda k: F.struct(
                    k.alias("open"),
                    F.concat(
                        acc["paths"],
                        F.array(
                            F.when(
                                F.size(k) > 0,
                                F.array_join(F.transform(k, lambda h: h["title"]), " > "),
                            )
                        ),
                    ).alias("paths"),
                ),
            )

        paths = F.aggregate(ps, start, step, lambda acc: acc["paths"])
        return F.filter(
            F.zip_with(
                ps,
                paths,
                lambda p, path: F.struct(path.alias("heading_path"), p["content"].alias("content")),
            ),
            lambda s: js_trim(s["content"]) != "",
        )

    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading_path"), text.alias("content")))
    found = let(
        F.split(text, _BEFORE_HEADING),
        lambda pieces: let(parts(pieces), with_paths),
    )
    headed = let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))
    return F.when(text.rlike(rf"(?dm)^{_HEADING}$"), headed).otherwise(whole)


def _strip_newline(c: Column, condition: Column) -> Column:
    return F.when(condition & c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c)


def split_sections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per section, numbered from zero; blank pages have none."""
    keep = [c for c in df.columns if c != text_col]
    text = F.col(text_col)
    return explode_once(df.filter(js_trim(text) != ""), keep, sections(text), "section_no", "s").select(
        *keep, "section_no", "s.heading_path", "s.content"
    )


def marked_pairs(content: Column) -> Column:
    """``Q: …``/``A: …`` pieces; empty unless two questions or more are marked."""

    def build(questions: Column) -> Column:
        answers = F.regexp_extract_all(content, F.lit(_MARKED_PAIR), F.lit(2))
        pairs = F.zip_with(
            questions,
            answers,
            lambda q, a: F.struct(js_trim(q).alias("q"), js_trim(a).alias("a")),
        )
        pieces = F.transform(
            F.filter(pairs, lambda p: p["q"] != ""),
            lambda p: F.concat(
                F.lit("Q: "),
                p["q"],
                F.when(F.coalesce(p["a"], F.lit("")) == "", F.lit("")).otherwise(
                    F.concat(F.lit("\nA: "), p["a"])
                ),
            ),
        )
        return F.when(F.size(questions) >= 2, pieces).otherwise(F.array().cast(_NO_STRINGS))

    return F.when(
        content.rlike("(?i)q:"),
        let(F.regexp_extract_all(content, F.lit(_MARKED_PAIR), F.lit(1)), build),
    ).otherwise(F.array().cast(_NO_STRINGS))


def question_pairs(content: Column) -> Column:
    """Question lines with the text below them; empty for fewer than three."""

    def pair(piece: Column) -> Column:
        lines = F.transform(F.split(piece, "\n"), js_trim)
        return let(
            lines,
            lambda ls: F.struct(
                F.get(ls, 0).alias("q"),
                F.array_join(F.filter(F.slice(ls, F.lit(2), F.size(ls)), lambda l: l != ""), " ").alias("a"),
            ),
        )

    def build(pieces: Column) -> Column:
        pairs = F.filter(
            F.transform(
                F.filter(pieces, lambda p: p.rlike(rf"(?d)^{_QUESTION_LINE}(?:\n|\z)")), pair
            ),
            lambda p: p["a"] != "",
        )
        return let(
            pairs,
            lambda ps: F.when(
                F.size(ps) >= 3,
                F.transform(ps, lambda p: F.concat(F.lit("Q: "), p["q"], F.lit("\nA: "), p["a"])),
            ).otherwise(F.array().cast(_NO_STRINGS)),
        )

    return F.when(
        content.contains("?"), let(F.split(content, _BEFORE_QUESTION), build)
    ).otherwise(F.array().cast(_NO_STRINGS))


def split_by_size(text: Column, target: int = TARGET_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Pack paragraphs into pieces of about ``target`` characters.

    Each new piece starts with the tail of the one before. A buffer that has
    outgrown the target is cut once, at a sentence end where there is one.
    """

    def cut(cur: Column, body) -> Column:
        return let(
            sentence_boundary(cur, target),
            lambda b: let(
                F.struct(
                    js_trim(F.left(cur, b)).alias("head"),
                    js_trim(F.substring(cur, b + 1, F.length(cur))).alias("rest"),
                ),
                body,
            ),
        )

    def long_enough(s: Column) -> Column:
        return F.when(F.length(s) >= MIN_CHUNK_CHARS, F.array(s)).otherwise(
            F.array().cast(_NO_STRINGS)
        )

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        glue = F.lit("\n\n")

        def flush_cut(c: Column) -> Column:
            rest = F.when(c["rest"] == "", F.lit("")).otherwise(F.concat(glue, c["rest"]))
            return F.struct(
                F.concat(acc["out"], long_enough(c["head"])).alias("out"),
                F.concat(F.right(c["head"], F.lit(overlap)), rest, glue, p).alias("cur"),
            )

        flush = F.struct(
            F.concat(acc["out"], F.array(cur)).alias("out"),
            F.concat(F.right(cur, F.lit(overlap)), glue, p).alias("cur"),
        )
        grow = F.struct(
            acc["out"].alias("out"),
            F.when(cur == "", p).otherwise(F.concat(cur, glue, p)).alias("cur"),
        )
        full = (F.length(cur) + F.length(p) > target) & (F.length(cur) > 0)
        return F.when(full & (F.length(cur) > target), cut(cur, flush_cut)).when(full, flush).otherwise(grow)

    def finish(acc: Column) -> Column:
        cur = acc["cur"]
        last = (
            F.when(js_trim(cur) == "", F.array().cast(_NO_STRINGS))
            .when(
                F.length(cur) > target,
                cut(cur, lambda c: F.concat(long_enough(c["head"]), long_enough(c["rest"]))),
            )
            .otherwise(F.array(cur))
        )
        return F.concat(acc["out"], last)

    start = F.struct(F.array().cast(_NO_STRINGS).alias("out"), F.lit("").alias("cur"))
    folded = F.aggregate(F.split(text, r"\n\n+"), start, step, finish)
    return F.when(F.length(text) <= target, F.array(text)).otherwise(folded)


def section_chunks(section: Column, title: Column) -> Column:
    """Chunks ``(content, snippet_of)`` of one section, question pairs first."""

    def build(prefix: Column) -> Column:
        def prefixed(piece: Column) -> Column:
            return F.when(prefix == "", piece).otherwise(F.concat(prefix, F.lit("\n\n"), piece))

        def faq(pieces: Column) -> Column:
            return F.filter(
                F.transform(
                    pieces,
                    lambda p: F.struct(
                        js_trim(prefixed(p)).alias("content"), prefixed(p).alias("snippet_of")
                    ),
                ),
                lambda c: F.length(c["content"]) >= MIN_CHUNK_CHARS,
            )

        sized = F.transform(
            F.filter(
                split_by_size(section["content"]),
                lambda p: F.length(js_trim(p)) >= MIN_CHUNK_CHARS,
            ),
            lambda p: F.struct(prefixed(js_trim(p)).alias("content"), p.alias("snippet_of")),
        )
        plain = let(
            faq(question_pairs(section["content"])),
            lambda lines: F.when(F.size(lines) > 0, lines).otherwise(sized),
        )
        return let(
            faq(marked_pairs(section["content"])),
            lambda marked: F.when(F.size(marked) > 0, marked).otherwise(plain),
        )

    return let(chunk_prefix(title, section["heading_path"]), build)


def chunk_pages(
    df: DataFrame, text_col: str = "text", title: Column | None = None
) -> DataFrame:
    """Chunk rows of each page; ``chunk_index`` runs over the page."""
    name = F.coalesce(title, F.lit("")) if title is not None else F.lit("")
    text = F.col(text_col)
    keep = [c for c in df.columns if c != text_col]

    def of_section(s: Column) -> Column:
        return F.transform(
            section_chunks(s, name),
            lambda c: F.struct(
                s["heading_path"].alias("heading_path"),
                c["content"].alias("content"),
                c["snippet_of"].alias("snippet_of"),
            ),
        )

    rows = explode_once(
        df.filter(js_trim(text) != ""),
        keep,
        F.flatten(F.transform(sections(text), of_section)),
        "chunk_index",
        "_c",
    )
    return rows.select(
        *keep,
        "chunk_index",
        F.col("_c.heading_path").alias("heading_path"),
        F.col("_c.content").alias("content"),
        snippet(F.col("_c.snippet_of")).alias("snippet"),
        estimate_tokens(F.col("_c.content")).alias("token_count"),
    )


def filter_boilerplate_chunks(chunks: DataFrame, content_col: str = "content") -> DataFrame:
    """Drop chunks that look like boilerplate; indexes keep their gaps."""
    return chunks.filter(~is_likely_boilerplate(F.col(content_col)))
