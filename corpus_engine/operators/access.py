"""Who may see what: memberships, share links, visibility, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_organizations(memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    """Organizations of each user, with the user's role."""
    return memberships.select("user_id", "org_id", "role").join(organizations, "org_id")


def organization_members(memberships: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members of each organization, with their profile as a struct."""
    rest = [c for c in profiles.columns if c != "user_id"]
    return memberships.join(profiles, "user_id").select(
        "org_id", "user_id", "role", F.struct(*rest).alias("profile")
    )


def visible_sites(sites: DataFrame, principal: Column, levels: tuple[str, ...] = ("public",)) -> DataFrame:
    """Own sites and sites of the given visibility."""
    return sites.filter((F.col("user_id") == principal) | F.col("visibility").isin(*levels))


def visible_rows(df: DataFrame, sites: DataFrame, principal: Column, kind: str = "content") -> DataFrame:
    """Rows that follow a visible site.

    ``content`` (chunks, pages, settings) follows own and public sites,
    ``conversations`` also sites behind a passcode, ``private`` (links, jobs,
    policies, usage, audit) own sites only.
    """
    levels = {"content": ("public",), "conversations": ("public", "passcode"), "private": ()}[kind]
    allowed = visible_sites(sites, principal, levels) if levels else sites.filter(F.col("user_id") == principal)
    return df.join(allowed.select("agent_id"), "agent_id", "left_semi")


def visible_organizations(organizations: DataFrame, memberships: DataFrame, principal: Column) -> DataFrame:
    """Organizations that a user belongs to or owns."""
    mine = memberships.filter(F.col("user_id") == principal).select("org_id", F.lit(True).alias("_m")).distinct()
    return (
        organizations.join(mine, "org_id", "left")
        .filter(F.col("_m").isNotNull() | (F.col("owner_id") == principal))
        .drop("_m")
    )


def live_links(links: DataFrame, as_of: Column) -> DataFrame:
    """Links that are neither revoked, expired nor used up."""
    return links.filter(
        F.col("revoked_at").isNull()
        & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
        & ((F.coalesce("max_uses", F.lit(0)) == 0) | (F.col("use_count") < F.col("max_uses")))
    )


def valid_share_links(links: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests ``(request_id, agent_id, token)`` with the live link they carry."""
    return requests.join(live_links(links, as_of).select("link_id", "agent_id", "token"), ["agent_id", "token"])


def accessible_sites(
    requests: DataFrame, sites: DataFrame, links: DataFrame, sessions: DataFrame, as_of: Column
) -> DataFrame:
    """Requests with ``allowed``.

    Public sites are open, private ones need a link, and those behind a passcode
    a link or a session ``(agent_id, session_id)``.
    """
    # requests are read once; several live links of one token count as one
    linked = live_links(links, as_of).select("agent_id", "token", F.lit(True).alias("_link")).distinct()
    entered = sessions.select("agent_id", "session_id", F.lit(True).alias("_session")).distinct()
    link = F.coalesce("_link", F.lit(False))
    session = F.coalesce("_session", F.lit(False))
    allowed = (
        F.when(F.col("visibility") == "public", True)
        .when(F.col("visibility") == "private", link)
        .otherwise(link | session)
    )
    return (
        requests.join(sites.select("agent_id", "visibility"), "agent_id")
        .join(linked, ["agent_id", "token"], "left")
        .join(entered, ["agent_id", "session_id"], "left")
        .select("request_id", "agent_id", allowed.alias("allowed"))
    )


def cascade_delete(tables: dict[str, DataFrame], site_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given sites; messages go with their conversations."""
    gone = site_ids.select("agent_id").distinct()
    out = {
        name: df.join(gone, "agent_id", "left_anti") for name, df in tables.items() if "agent_id" in df.columns
    }
    if "messages" in tables and "conversations" in tables:
        lost = tables["conversations"].join(gone, "agent_id", "left_semi").select("conversation_id")
        out["messages"] = tables["messages"].join(lost, "conversation_id", "left_anti")
    return out


def drop_jobs(pages: DataFrame, jobs: DataFrame, job_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove jobs; their pages stay without a job."""
    gone = job_ids.select(F.col("job_id").alias("crawl_job_id"), F.lit(True).alias("_gone")).distinct()
    kept = jobs.join(job_ids.select("job_id"), "job_id", "left_anti")
    cleared = (
        pages.join(gone, "crawl_job_id", "left")
        .withColumn("crawl_job_id", F.when(F.col("_gone").isNull(), F.col("crawl_job_id")))
        .drop("_gone")
    )
    return cleared, kept
