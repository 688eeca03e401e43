"""Stored sitemap bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.collections import explode_once
from corpus_engine.functions.text import js_trim


def parse_sitemaps(df: DataFrame) -> DataFrame:
    """``(sitemap_url, loc, is_child)`` of bodies ``(sitemap_url, body)``."""
    body = F.col("body")
    lines = F.filter(F.transform(F.split(body, "\n"), js_trim), lambda l: l.startswith("http"))
    tags = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), js_trim
    )
    plain = F.col("sitemap_url").endswith(".txt") & ~js_trim(body).startswith("<")
    rows = explode_once(df, ["sitemap_url"], F.when(plain, lines).otherwise(tags), "_pos", "loc")
    child = F.col("loc").contains("sitemap") & F.col("loc").endswith(".xml")
    return rows.select("sitemap_url", "loc", child.alias("is_child"))


def sitemap_urls(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Page URLs of the source sitemaps, child sitemaps expanded one level."""
    parsed = parse_sitemaps(df)
    top = parsed.join(sources.select("sitemap_url").distinct(), "sitemap_url", "left_semi")
    children = top.filter("is_child").select(F.col("loc").alias("sitemap_url")).distinct()
    below = parsed.join(children, "sitemap_url", "left_semi")
    return top.filter(~F.col("is_child")).select("loc").unionByName(below.select("loc"))
