"""Crawl order over a stored link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.urls import is_in_domain_scope, normalize_url, path_allowed, should_skip_url
from corpus_engine.runtime import durable, top_per_group


def crawl_order(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int = 5,
    max_pages: int | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """URLs reachable from the seeds of each site, breadth first, with their depth.

    ``edges(src_url, pos, dst_url)`` are links of fetched pages; ``seeds(site,
    root_url, url, pos[, allowed])`` start at depth zero. Links must pass the path,
    scope and skip rules, must not be in ``blocked(url)`` and must be new. Each level
    is one join and one anti-join and is written to the shared folder.

    With ``max_pages`` a site's queue is cut there, in the order of the positions on
    the way from the seed, and ``dropped`` counts the site's URLs that were cut off.
    """
    allowed = F.col("allowed") if "allowed" in seeds.columns else None
    extra = ["allowed"] if allowed is not None else []

    def admissible(df: DataFrame) -> DataFrame:
        return df.filter(
            path_allowed(F.col("url"), include or [], exclude or [])
            & is_in_domain_scope(F.col("url"), F.col("root_url"), allowed)
            & ~should_skip_url(F.col("url"), allow_pdf=True)
        )

    sites = durable(seeds.groupBy("site").agg(F.min(F.struct("root_url", *extra)).alias("_s")).select("site", "_s.*"))
    links = edges.select(
        normalize_url(F.col("src_url")).alias("src"), "pos", normalize_url(F.col("dst_url")).alias("url")
    )
    # written first, so that the filter does not normalise the URLs again
    links = durable(links.groupBy("src", "url").agg(F.min("pos").alias("pos"))).filter("src <> url")

    if blocked is not None:
        blocked = durable(blocked.select("url").distinct())  # every level asks for it

    start = admissible(
        seeds.withColumn("url", normalize_url(F.col("url"))).withColumn("root_url", normalize_url(F.col("root_url")))
    )
    level = durable(
        start.groupBy("site", "url").agg(F.min(F.array(F.col("pos").cast("bigint"))).alias("way")).withColumn("depth", F.lit(0))
    )
    reached, cut = level, []
    for depth in range(1, max_depth + 1):
        found = (
            level.join(links, F.col("src") == level["url"])
            .select(level["site"], links["url"], F.concat("way", F.array(F.col("pos").cast("bigint"))).alias("way"))
            .groupBy("site", "url")
            .agg(F.min("way").alias("way"))
            .join(reached.select("site", "url"), ["site", "url"], "left_anti")
        )
        if blocked is not None:
            found = found.join(blocked, "url", "left_anti")
        found = admissible(found.join(sites, "site")).select("site", "url", "way")
        ranked = found.withColumn("depth", F.lit(depth))
        if max_pages is not None:
            queued = reached.groupBy("site").agg(F.count("*").alias("_queued"))
            total = durable(found.groupBy("site").agg(F.count("*").alias("_found")).join(queued, "site"))
            cut.append(total.select("site", F.greatest(F.col("_found") + F.col("_queued") - max_pages, F.lit(0)).alias("n")))
            ranked = top_per_group(ranked, ["site"], [F.col("way"), F.col("url")], max_pages).join(queued, "site")
            ranked = ranked.filter(F.col("rn") + F.col("_queued") <= max_pages)
        level = durable(ranked.select("site", "url", "way", "depth"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    out = reached.select("site", "url", "depth", "way")
    if max_pages is None:
        return out
    dropped = reduce(DataFrame.unionByName, cut).groupBy("site").agg(F.sum("n").alias("dropped")) if cut else None
    if dropped is None:
        return out.withColumn("dropped", F.lit(0).cast("bigint"))
    return out.join(dropped, "site", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


def link_stats(edges: DataFrame, fetched: DataFrame) -> DataFrame:
    """Discovered and crawled URLs per site: ``edges(site, url)``, ``fetched(site, url)``."""
    known = edges.select("site", "url").unionByName(fetched.select("site", "url")).distinct()
    have = fetched.select("site", "url", F.lit(1).alias("_f")).distinct()
    return (
        known.join(have, ["site", "url"], "left")
        .groupBy("site")
        .agg(F.count("*").alias("discovered"), F.count("_f").alias("crawled"))
    )
