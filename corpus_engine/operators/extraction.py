"""Page extraction: one parse of each page gives typed columns, which the rest reads.

The parser runs in Arrow batches and decodes every character reference, in texts and in
attributes. Links, linked data, tables, image texts and the text walk come from the
same tree; what is made of them are Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions import markup as M
from corpus_engine.functions.collections import explode_once
from corpus_engine.functions.text import dedupe_lines, js_trim, or_else
from corpus_engine.functions.urls import resolve_link
from corpus_engine.runtime import bound_batches

# Fixed value: the type of linked-data scripts.
LINKED_DATA = "application/ld+json"

# What is removed, by tag, class, id and role.
NOISE_TAGS = {"script", "style", "noscript", "iframe", "svg"}
NOISE_CLASSES = {
    "cookie-banner", "cookie-notice", "cookie-consent", "popup", "modal", "overlay",
    "advertisement", "ad", "ads", "adsbygoogle", "social-share", "social-links", "comments",
}
NOISE_IDS = {"comments"}
FRAME_TAGS = ("nav", "footer", "header")
FRAME_ROLES = ("navigation", "banner", "contentinfo")
FRAME_CLASSES = ("sidebar", "widget")

HEADING_MARKS = {"h1": "##", "h2": "###", "h3": "####", "h4": "#####", "h5": "######", "h6": "######"}
TEXT_BLOCKS = {"p", "blockquote", "figcaption", "dd", "dt", "pre", "address", "summary", "details"}
INNER_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "table", "ul", "ol", "blockquote", "div"}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}
# a start tag of the key closes an open tag of the value
CLOSES = {
    **{t: {"p"} for t in INNER_BLOCKS | {"article", "section", "main", "nav", "footer", "header", "pre", "address", "details"}},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
}
# elements whose content is text even where it looks like tags
TEXT_ONLY = {"textarea", "title"}
_SCOPES = {"table", "ul", "ol", "dl", "body", "html"}


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self, without: frozenset | set = frozenset()) -> str:
        out, todo = [], [c for c in reversed(self.children) if isinstance(c, str) or c.tag not in without]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)

    def walk(self) -> Iterator["Element"]:
        todo = [c for c in reversed(self.children) if not isinstance(c, str)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def has_class(self, names: set[str]) -> bool:
        return not names.isdisjoint(self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    """A small tree: void tags, implied end tags, texts that hold no tags, nothing more."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("#root", {})]

    def _in_text(self) -> bool:
        return self.open[-1].tag in TEXT_ONLY

    def handle_starttag(self, tag, attrs):
        if self._in_text():
            self.handle_data(self.get_starttag_text() or "")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in CLOSES.get(tag, ()):
                del self.open[i:]
                if tag != "tr":
                    break
            elif self.open[i].tag in _SCOPES:
                break
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # the slash means nothing in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self._in_text() and tag != self.open[-1].tag:
            self.handle_data(f"</{tag}>")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _noise(e: Element) -> bool:
    return e.tag in NOISE_TAGS or e.has_class(NOISE_CLASSES) or e.attrs.get("id") in NOISE_IDS


def _frame(e: Element) -> bool:
    return any(kind(e) for kind in FRAMES)


FRAMES = (
    *(lambda e, t=t: e.tag == t for t in FRAME_TAGS),
    *(lambda e, r=r: e.attrs.get("role") == r for r in FRAME_ROLES),
    *(lambda e, c=c: e.has_class({c}) for c in FRAME_CLASSES),
)


def _prune(e: Element) -> None:
    todo = [e]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not (_noise(c) or _frame(c))]
        todo.extend(c for c in node.children if not isinstance(c, str))


def table_markdown(table: Element) -> str:
    rows = []
    for tr in table.walk():
        if tr.tag == "tr":
            cells = [
                c.text().strip().replace("|", "\\|").replace("\n", " ") for c in tr.walk() if c.tag in ("td", "th")
            ]
            if cells:
                rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def _piece(e: Element) -> str | None:
    if e.tag in HEADING_MARKS:
        return f"\n{HEADING_MARKS[e.tag]} {e.text().strip()}\n"
    if e.tag == "table":
        table = table_markdown(e)
        return f"\n{table}\n" if table else None
    if e.tag in TEXT_BLOCKS or e.tag == "li":
        text = e.text({"ul", "ol"} if e.tag == "li" else INNER_BLOCKS).strip()
        return (f"- {text}" if e.tag == "li" else text) if text else None
    return None


_PARTS = (
    "title_text string, heading string, language string, canonical string, metas array<struct<name:string,property:string,content:string>>, "
    "scripts array<string>, links array<string>, images array<string>, tables array<string>, "
    "frame_text string, body_text string, walked string"
)
PART_NAMES = [f.split()[0] for f in _PARTS.split(", ")]

#: Characters of HTML whose parts are held at once.
FRAME_CHARS = 1_000_000


def page_parts(html: str | None) -> dict:
    """The typed parts of one page; an empty or null page has empty ones."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.open[0]
    every = list(root.walk())

    def first(tag: str) -> str:
        found = next((e for e in every if e.tag == tag), None)
        return found.text() if found else ""

    top = next((e for e in every if e.tag == "html"), None)
    canonical = next((e for e in every if e.tag == "link" and e.attrs.get("rel", "").lower() == "canonical"), None)
    metas = [{k: e.attrs.get(k, "") for k in ("name", "property", "content")} for e in every if e.tag == "meta"]
    scripts = [e.text() for e in every if e.tag == "script" and e.attrs.get("type", "").strip().lower() == LINKED_DATA]
    links = [e.attrs["href"] for e in every if e.tag == "a" and e.attrs.get("href")]
    body = next((e for e in every if e.tag == "body"), root)
    # kind after kind, so that numbers come in the order of the kinds, not of the page
    frame = " ".join(e.text() for kind in FRAMES for e in every if kind(e))
    out = {
        "title_text": first("title"),
        "heading": first("h1"),
        "language": top.attrs.get("lang", "") if top else "",
        "canonical": canonical.attrs.get("href", "") if canonical else "",
        "metas": metas,
        "scripts": scripts,
        "links": links,
        "frame_text": frame,
        "body_text": body.text(),
    }
    _prune(root)
    mains = [e for e in root.walk() if e.tag in ("main", "article") or e.attrs.get("role") == "main"] or [body]
    seen: set[int] = set()
    pieces, tables = [], []
    for main in mains:
        for e in main.walk():
            if id(e) not in seen:
                seen.add(id(e))
                piece = _piece(e)
                if piece is not None:
                    pieces.append(piece)
                    if e.tag == "table":
                        tables.append(piece.strip("\n"))
    alts = (img.attrs.get("alt", "").strip() for img in root.walk() if img.tag == "img")
    out["images"] = [f"[Image: {alt}]" for alt in alts if 5 < len(alt) < 200]
    out["tables"] = tables
    out["walked"] = "\n".join(pieces + out["images"])
    return out


def parse_frame(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The parsed pages of a batch, in frames of about ``FRAME_CHARS`` characters of HTML; a page is never cut."""
    ends = pdf["html"].str.len().fillna(0).cumsum()
    for _, part in pdf.groupby(ends // FRAME_CHARS, sort=False):
        found = [page_parts(h) for h in part.pop("html")]
        yield part.assign(**{n: pd.Series([f[n] for f in found], index=part.index, dtype=object) for n in PART_NAMES})


def parse_pages(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but ``html``, and the typed parts of each page.

    A task holds the parts of a few pages at a time, not those of a whole Arrow batch.
    """
    keep = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "raw_html_length bigint", _PARTS])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from parse_frame(pdf)

    bound_batches(pages.sparkSession)
    return pages.withColumn("raw_html_length", F.length("html").cast("bigint")).mapInPandas(parse, schema)


def with_metadata(parsed: DataFrame) -> DataFrame:
    """Parsed pages with title, description, canonical address, language and Open Graph map."""
    metas = F.col("metas")
    code = F.element_at(F.split("language", "-"), 1)
    named = {
        "title": F.coalesce(or_else(M.meta(metas, "property", "og:title"), js_trim("title_text"), js_trim("heading")), F.lit("")),
        "description": F.coalesce(
            or_else(M.meta(metas, "name", "description"), M.meta(metas, "property", "og:description")), F.lit("")
        ),
        "canonical": F.nullif("canonical", F.lit("")),
        "language": F.coalesce(or_else(code), F.lit("en")),
        "open_graph": M.open_graph(metas),
    }
    return parsed.withColumns(named)


def extract_links(pages: DataFrame) -> DataFrame:
    """``(src_url, pos, dst_url)`` of every valid link, repetitions kept."""
    parsed = parse_pages(pages.select(F.col("url").alias("src_url"), "html")).select("src_url", "links")
    # resolved before the explode: a filter on a computed column computes it twice
    targets = F.transform("links", lambda h: resolve_link(h, F.col("src_url")))
    rows = explode_once(parsed, ["src_url"], targets, "pos", "dst_url")
    return rows.filter(F.col("dst_url").isNotNull())


def main_text(walked):
    """Walk output with collapsed blank lines and without repeated lines."""
    squeezed = js_trim(F.regexp_replace(walked, r"\n{3,}", "\n\n"))
    return js_trim(F.regexp_replace(dedupe_lines(squeezed), r"\n{3,}", "\n\n"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Metadata, contacts, main text and full text of pages ``(page_id, url, html)``."""
    parsed = with_metadata(parse_pages(pages.select("page_id", "url", "html")))
    text = F.concat_ws(
        "\n\n", F.nullif(F.array_join("contacts", "\n"), F.lit("")), F.col("main_text")
    )
    return (
        parsed.withColumn("contacts", M.contacts(F.col("frame_text"), F.col("body_text")))
        .withColumn("main_text", main_text(F.col("walked")))
        .withColumn("page_text", js_trim(text))
        .select(
            "page_id", "url", "title", "description", "canonical", "language", "raw_html_length",
            "contacts", "images", "tables", "main_text", "page_text",
        )
    )


def structured_data(pages: DataFrame) -> DataFrame:
    """Linked data, Open Graph map, owner and the text form of each page."""
    parsed = with_metadata(parse_pages(pages.select("page_id", "html")))
    return (
        parsed.select("page_id", "metas", M.json_ld(F.col("scripts")).alias("json_ld"), "open_graph")
        .withColumn("company", M.company_meta(F.col("json_ld"), F.col("open_graph"), F.col("metas")))
        .withColumn("text", M.structured_data_to_text(F.col("company"), F.col("json_ld")))
        .drop("metas")
    )
