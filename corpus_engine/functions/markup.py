"""What is made of the parsed parts of a page, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.text import collapse_ws, js_trim, or_else

# Marks of script-built pages.
SPA_ROOTS = (
    '<div id="root"', '<div id="app"', '<div id="__next"', '<div id="__nuxt"', '<div id="__gatsby"', 'id="svelte"',
)
SPA_IDS = ('id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"')

# Contact patterns.
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def meta(metas: Column, key: str, value: str) -> Column:
    """Content of the first ``meta`` tag with the given attribute."""
    return F.get(F.filter(metas, lambda m: m[key] == value), 0)["content"]


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def phones(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), js_trim))


def contacts(region_text: Column, body_text: Column) -> Column:
    """Telephone numbers of the page frame, then all mail addresses."""
    return F.concat(
        F.transform(phones(region_text), lambda p: F.concat(F.lit("Phone: "), p)),
        F.transform(emails(body_text), lambda e: F.concat(F.lit("Email: "), e)),
    )


def open_graph(metas: Column) -> Column:
    """``og:`` properties; the last of equal names wins."""
    named = F.transform(
        F.filter(metas, lambda m: m["property"].startswith("og:") & (F.length(m["property"]) > 3) & (m["content"] != "")),
        lambda m: F.struct(F.substring(m["property"], 4, 1 << 30).alias("k"), m["content"].alias("v")),
    )
    # keep only the last entry of each name, so any duplicate policy will do
    last = F.filter(
        F.transform(named, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: ~F.exists(F.slice(named, p["i"] + 2, F.size(named)), lambda q: q["k"] == p["k"]),
    )
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def json_ld(scripts: Column) -> Column:
    """JSON texts of all linked-data objects; arrays are flattened, bad ones skipped."""
    as_lists = F.transform(
        F.filter(scripts, lambda s: F.try_parse_json(s).isNotNull()),
        lambda s: F.when(
            js_trim(s).startswith("["),
            F.transform(
                F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"), lambda v: F.to_json(v)
            ),
        ).otherwise(F.array(F.to_json(F.try_parse_json(s)))),
    )
    return F.flatten(as_lists)


def _of_type(objects: Column, *kinds: str) -> Column:
    return F.get(F.filter(objects, lambda o: F.get_json_object(o, "$['@type']").isin(*kinds)), 0)


def company_meta(objects: Column, graph: Column, metas: Column) -> Column:
    """Name, description, phone, mail and address of the site's owner."""
    org = _of_type(objects, "Organization", "LocalBusiness")

    def of_org(path: str) -> Column:
        return F.nullif(F.get_json_object(org, path), F.lit(""))

    parts = F.array(
        *[of_org(f"$.address.{p}") for p in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    )
    name = or_else(
        F.get_json_object(_of_type(objects, "Organization"), "$.name"),
        F.try_element_at(graph, F.lit("site_name")),
        meta(metas, "name", "application-name"),
    )
    return F.struct(
        name.alias("company_name"),
        or_else(meta(metas, "name", "description"), F.try_element_at(graph, F.lit("description"))).alias("description"),
        of_org("$.telephone").alias("phone"),
        of_org("$.email").alias("email"),
        F.nullif(F.array_join(parts, ", "), F.lit("")).alias("address"),
    )


_FAQ = "array<struct<`@type`: string, name: string, acceptedAnswer: struct<text: string>>>"


def structured_data_to_text(owner: Column, objects: Column) -> Column:
    """Owner lines, then questions and products, as plain text."""
    labels = (
        ("Company", "company_name"), ("Description", "description"), ("Phone", "phone"), ("Email", "email"), ("Address", "address"),
    )
    head = F.array(*[F.concat(F.lit(f"{label}: "), owner[field]) for label, field in labels])

    def faq(o: Column) -> Column:
        entries = F.from_json(F.get_json_object(o, "$.mainEntity"), _FAQ)
        lines = F.transform(
            F.filter(entries, lambda q: q["@type"] == "Question"),
            lambda q: F.array(
                F.concat(F.lit("Q: "), q["name"]), F.concat(F.lit("A: "), q["acceptedAnswer"]["text"])
            ),
        )
        return F.concat(F.array(F.lit("\nFrequently Asked Questions:")), F.flatten(lines))

    def product(o: Column) -> Column:
        price = F.nullif(F.get_json_object(o, "$.offers.price"), F.lit(""))
        return F.array(
            F.concat(F.lit("\nProduct: "), F.get_json_object(o, "$.name")),
            F.concat(F.lit("Description: "), F.nullif(F.get_json_object(o, "$.description"), F.lit(""))),
            F.concat(
                F.lit("Price: "), F.coalesce(F.get_json_object(o, "$.offers.priceCurrency"), F.lit("")), price
            ),
        )

    none = F.array().cast("array<string>")
    blocks = F.transform(
        objects,
        lambda o: F.when(F.get_json_object(o, "$['@type']") == "FAQPage", F.coalesce(faq(o), none))
        .when(F.get_json_object(o, "$['@type']") == "Product", product(o))
        .otherwise(none),
    )
    return F.array_join(F.concat(head, F.flatten(blocks)), "\n")


def likely_spa(html: Column) -> Column:
    """A script root is present and the body holds hardly any text."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    text = body
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, "")
    has_root = F.lit(False)
    for mark in SPA_ROOTS:
        has_root = has_root | html.contains(mark)
    return has_root & html.rlike(r"(?is)<body[^>]*>.*?</body>") & (F.length(collapse_ws(text)) < 200)


def maybe_spa(html: Column) -> Column:
    """The looser test: any of four id marks."""
    found = F.lit(False)
    for mark in SPA_IDS:
        found = found | html.contains(mark)
    return found


def page_gate(content_type: Column, text: Column) -> Column:
    """``(page_type, needs_browser, keep)`` by content type and text length."""
    html = content_type.contains("text/html") | content_type.contains("application/xhtml")
    kind = F.when(html, "html").when(content_type.contains("application/pdf"), "pdf").otherwise("dropped")
    size = F.length(F.coalesce(text, F.lit("")))
    return F.struct(
        kind.alias("page_type"),
        (html & (size < 100)).alias("needs_browser"),
        ((kind != "dropped") & (size >= 50)).alias("keep"),
    )
