"""Result shaping: re-ranking, citations, page lookups, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.text import or_else
from corpus_engine.functions.urls import is_in_domain_scope, normalize_url, should_skip_url
from corpus_engine.runtime import top_per_group



def attach_pages(hits: DataFrame, pages: DataFrame, columns: tuple[str, ...] = ("url", "title")) -> DataFrame:
    """Page columns for each hit, empty where the page is unknown.

    Hits are few per query, so Spark broadcasts them into the semi-join that
    cuts the page table before the lookup.
    """
    wanted = pages.join(hits.select("page_id").distinct(), "page_id", "left_semi").select("page_id", *columns)
    out = hits.join(wanted, "page_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    return out


def rerank(hits: DataFrame, ranking: DataFrame, k: int = 6) -> DataFrame:
    """Apply index lists ``ranking(query_id, indices)`` to hits numbered by ``orig``.

    Valid indices count once each, in their order; missing places are filled in
    the original order. Without a list, or with ``k`` hits or fewer, the order
    stays. Hits per query are the few of one search.
    """
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    places = (
        ranking.join(sizes, "query_id")
        .filter(F.col("_n") > k)
        .select(
            "query_id",
            F.posexplode(
                F.slice(
                    F.array_distinct(F.filter("indices", lambda i: (i >= 0) & (i < F.col("_n")))), 1, k
                )
            ).alias("_place", "orig"),
        )
    )
    order = [F.col("_place").asc_nulls_last(), F.col("orig")]
    joined = hits.join(places, ["query_id", "orig"], "left")
    return top_per_group(joined, ["query_id"], order, k, "rank").drop("_place")


def citations(hits: DataFrame, pages: DataFrame, n: int = 5, fallback: bool = False) -> DataFrame:
    """Sources of the best ``n`` hits; rows without a URL go after the cut."""
    top = top_per_group(hits, ["query_id"], [F.col("rank")], n, "_rn").drop("_rn")
    cited = attach_pages(top, pages).filter(F.col("url") != "")
    head = F.left("content", F.lit(150))
    text = F.concat(head, F.lit("...")) if fallback else head
    title = or_else(F.col("title"), F.col("url")) if fallback else F.col("title")
    return cited.withColumn("snippet", or_else(F.col("snippet"), text)).withColumn(
        "title", F.coalesce(title, F.lit(""))
    )


def paginate(
    df: DataFrame, order: list[Column], page: int, size: int, where: Column | None = None
) -> DataFrame:
    """One page of a listing, with the exact total and the number of pages.

    The total comes from a count over the same rows, which reads no columns.
    """
    rows = df if where is None else df.filter(where)
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    # one row of totals joined on a constant
    return cut.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "total_pages", F.ceil(F.col("total") / size)
    )


def page_tree(pages: DataFrame) -> DataFrame:
    """Pages in URL order."""
    return pages.orderBy("agent_id", "url")


def latest_per_site(df: DataFrame, n: int, order: list[Column], site: str = "agent_id") -> DataFrame:
    """Newest ``n`` rows per site."""
    return top_per_group(df, [site], order, n)


def site_url_map(
    sites: DataFrame, sitemap_urls: DataFrame, home_links: DataFrame, limit: int | None, site: str = "agent_id"
) -> DataFrame:
    """URLs of each site with the number of all of them; the first ``limit`` in order, or all for None.

    ``sites(site, root_url)``; ``sitemap_urls`` and ``home_links`` have ``site, url``.
    """
    start = sites.select(site, normalize_url(F.col("root_url")).alias("url"))
    roots = start.withColumnRenamed("url", "_root")
    found = sitemap_urls.select(site, "url").unionByName(home_links.select(site, "url"))
    found = found.select(site, normalize_url(F.col("url")).alias("url")).distinct().join(roots, site)
    found = found.filter(
        ~should_skip_url(F.col("url"), allow_pdf=True) & is_in_domain_scope(F.col("url"), F.col("_root"))
    )
    urls = start.unionByName(found.drop("_root")).distinct()
    total = urls.groupBy(site).agg(F.count("*").alias("discovered"))
    first = urls if limit is None else top_per_group(urls, [site], [F.col("url")], limit).drop("rn")
    return first.join(total, site)


def search_sites(sites: DataFrame, needle: str) -> DataFrame:
    """Sites whose name or root URL holds the needle, newest first."""
    low = F.lower(F.lit(needle))
    return sites.filter(
        F.lower("name").contains(low) | F.lower("root_url").contains(low)
    ).orderBy(F.col("created_at").desc(), "agent_id")
