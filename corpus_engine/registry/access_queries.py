"""Access rules; customers stand in for sites, nations for organizations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.operators import access as A
from corpus_engine.registry import query
from corpus_engine.registry.analytics_queries import at, sites
from corpus_engine.sources.tables import load_table



def _memberships(spark, d):
    return load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id"), F.lower("c_mktsegment").alias("role")
    )


def _organizations(spark, d):
    return load_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") * 3).cast("bigint").alias("owner_id")
    )


@query(
    """SELECT c_custkey AS user_id, c_nationkey AS org_id, lower(c_mktsegment) AS role, n_name AS name
       FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def user_organizations(spark, d):
    return A.user_organizations(_memberships(spark, d), _organizations(spark, d).drop("owner_id"))


@query(
    """SELECT c_nationkey AS org_id, c_custkey AS user_id, lower(c_mktsegment) AS role, c_name AS full_name FROM customer"""
)
def organization_members(spark, d):
    profiles = load_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"))
    return A.organization_members(_memberships(spark, d), profiles).select(
        "org_id", "user_id", "role", F.col("profile.full_name").alias("full_name")
    )


@query(
    """SELECT o_orderkey AS page_id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey
         AND (c_nationkey = 7 OR c_mktsegment IN ('BUILDING', 'FURNITURE')))"""
)
def visible_rows(spark, d):
    pages = load_table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(
        F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("agent_id")
    )
    return A.visible_rows(pages, sites(spark, d), F.lit(7)).select("page_id")


@query(
    """SELECT n_nationkey AS org_id FROM nation WHERE n_regionkey * 3 = 6
       OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 6)"""
)
def visible_organizations(spark, d):
    return A.visible_organizations(_organizations(spark, d), _memberships(spark, d), F.lit(6)).select("org_id")


def _links(spark, d):
    """Orders as links to their customer; every third order is unlimited."""
    o = F.col("o_orderkey")
    return load_table(spark, d, "orders").select(
        o.alias("link_id"), F.col("o_custkey").alias("agent_id"), F.concat(F.lit("t"), o).alias("token"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("expires_at"),
        (o % 3 * 5).cast("int").alias("max_uses"), (o % 11).cast("int").alias("use_count"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("revoked_at"),
    )


def _requests(spark, d):
    """Line items as requests, some of them for another site."""
    o = F.col("l_orderkey")
    owner = load_table(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_orderkey", "l_orderkey")
    return load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"]).join(owner, "l_orderkey").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("request_id"),
        F.when(F.col("l_linenumber") < 5, F.col("o_custkey")).otherwise(F.col("l_suppkey")).alias("agent_id"),
        F.concat(F.lit("t"), o).alias("token"),
        F.col("l_suppkey").alias("session_id"),
    ).distinct()


_SQL = """
  r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS request_id,
          CASE WHEN l_linenumber < 5 THEN o_custkey ELSE l_suppkey END AS agent_id, l_orderkey AS link_id, l_suppkey AS session_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  k AS (SELECT o_orderkey AS link_id, o_custkey AS agent_id FROM orders WHERE o_orderstatus <> 'P'
        AND (o_orderpriority = '1-URGENT' OR o_orderdate >= TIMESTAMP '1999-01-01')
        AND (o_orderkey % 3 = 0 OR o_orderkey % 11 < o_orderkey % 3 * 5)),
  v AS (SELECT request_id, link_id FROM r JOIN k USING (link_id, agent_id))"""


@query(f"WITH {_SQL} SELECT request_id, link_id FROM v")
def valid_share_links(spark, d):
    return A.valid_share_links(_links(spark, d), _requests(spark, d), at("1999-01-01")).select("request_id", "link_id")


@query(
    f"""WITH {_SQL} SELECT request_id, r.agent_id, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN true
          WHEN c_mktsegment = 'MACHINERY' THEN v.request_id IS NOT NULL
          ELSE v.request_id IS NOT NULL OR (s_suppkey IS NOT NULL) END AS allowed
        FROM r JOIN customer ON c_custkey = r.agent_id LEFT JOIN v USING (request_id)
        LEFT JOIN supplier ON s_suppkey = r.session_id AND s_suppkey = r.agent_id"""
)
def accessible_sites(spark, d):
    kind = F.col("c_mktsegment")
    owners = load_table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).select(
        F.col("c_custkey").alias("agent_id"),
        F.when(kind.isin("BUILDING", "FURNITURE"), "public").when(kind == "MACHINERY", "private").otherwise("passcode").alias("visibility"),
    )
    sessions = load_table(spark, d, "supplier", ["s_suppkey"]).select(
        F.col("s_suppkey").alias("agent_id"), F.col("s_suppkey").alias("session_id")
    )
    return A.accessible_sites(_requests(spark, d), owners, _links(spark, d), sessions, at("1999-01-01"))


@query(
    """WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)
       SELECT 'sites' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone)
       UNION ALL SELECT 'conversations', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)
       UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey NOT IN
         (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM gone))"""
)
def cascade_delete(spark, d):
    tables = {
        "sites": sites(spark, d),
        "conversations": load_table(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumnsRenamed(
            {"o_orderkey": "conversation_id", "o_custkey": "agent_id"}
        ),
        "messages": load_table(spark, d, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "conversation_id"),
    }
    gone = load_table(spark, d, "customer", ["c_custkey"], F.col("c_acctbal") < 0).withColumnRenamed("c_custkey", "agent_id")
    left = A.cascade_delete(tables, gone)
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
