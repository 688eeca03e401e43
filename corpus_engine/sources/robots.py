"""Stored robots files: rules, and URLs allowed by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.functions.collections import explode_once
from corpus_engine.functions.text import js_trim
from corpus_engine.functions.urls import host

RULES = ("allow", "disallow", "crawl-delay")


def parse_robots(df: DataFrame) -> DataFrame:
    """``(host, agent, rule, value)`` of files ``(host, body)``.

    Consecutive ``User-agent`` lines share the rules below them. ``Sitemap`` lines
    stand alone and have no agent. A file is one small row, so windows per host
    stay small.
    """
    rows = explode_once(df, ["host"], F.split("body", "\n"), "pos", "line")
    line = js_trim(F.regexp_replace("line", r"#.*\z", ""))
    parts = rows.select(
        "host",
        "pos",
        F.lower(js_trim(F.regexp_extract(line, r"^([^:]+):", 1))).alias("rule"),
        js_trim(F.regexp_extract(line, r"^[^:]+:(.*)\z", 1)).alias("value"),
    ).filter(F.col("rule") != "")
    sitemaps = parts.filter((F.col("rule") == "sitemap") & F.col("value").startswith("http")).select(
        "host", F.lit(None).cast("string").alias("agent"), "rule", "value"
    )
    order = Window.partitionBy("host").orderBy("pos")
    is_agent = F.col("rule") == "user-agent"
    grouped = (
        parts.filter(is_agent | F.col("rule").isin(*RULES))
        .withColumn("_new", is_agent & (F.coalesce(F.lag("rule").over(order), F.lit("")) != "user-agent"))
        .withColumn("_group", F.sum(F.col("_new").cast("int")).over(order))
    )
    agents = grouped.filter(is_agent).select("host", "_group", F.lower("value").alias("agent"))
    rules = grouped.filter(~is_agent).select("host", "_group", "rule", "value")
    return agents.join(rules, ["host", "_group"]).select("host", "agent", "rule", "value").unionByName(sitemaps)


def path_pattern(path: Column) -> Column:
    """Rule path as a regex: ``*`` is any text, a final ``$`` the end."""
    escaped = F.regexp_replace(path, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(
        F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\\\$\z", r"\\z")
    )


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """``urls(url, …)`` with ``allowed``; the longest matching path decides.

    Rules for the agent itself replace those for ``*``. A host without rules
    allows everything.
    """
    name = agent.lower()
    paths = rules.filter(F.col("rule").isin("allow", "disallow") & F.col("agent").isin(name, "*"))
    own = rules.filter(F.col("agent") == name).select("host").distinct()
    mine = paths.filter(F.col("agent") == name).unionByName(
        paths.filter(F.col("agent") == "*").join(own, "host", "left_anti")
    )
    # a host has few rules; keep them as one list so that URLs stay single rows
    lists = mine.filter(F.col("value") != "").groupBy("host").agg(
        F.collect_set(
            F.struct(
                F.length("value").alias("size"), (F.col("rule") == "allow").alias("allow"), path_pattern(F.col("value")).alias("pattern")
            )
        ).alias("_rules")
    )
    target = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^#]*)", 1)
    joined = urls.withColumn("_host", host(F.col("url"))).withColumn("_target", target)
    joined = joined.join(lists.withColumnRenamed("host", "_host"), "_host", "left")
    best = F.array_max(F.filter("_rules", lambda r: F.rlike(F.col("_target"), r["pattern"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_target", "_rules")


def crawl_allowed(body: Column) -> Column:
    """False when the file closes the whole site; no file allows it."""
    return F.coalesce(~body.rlike(r"(?im)disallow:\s*/\s*$"), F.lit(True))
