"""Queries over entity resolution, merging and survivorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import merge as M
from ..operators import resolve as R
from ..registry import query
from ..sources import domain as D
from .keys import _LEGAL, _SUFFIXED, suffixed_companies


def _people(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("mention_id").alias("id"), "display_name", "city", "company", F.array().cast("array<string>").alias("education"))


def _handles(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("mention_id").alias("id"), F.lit("github").alias("kind"), F.col("github").alias("value"))


_WITHDRAWN = "SELECT github FROM mention GROUP BY github HAVING count(DISTINCT display_name) > 1"


@query(D.with_views("mention", sql="SELECT 'github' AS kind, github AS value FROM mention GROUP BY github HAVING count(DISTINCT display_name) > 1"))
def handles_of_strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.mentions(spark, sf_dir)
    return R.shared_by_strangers(_handles(rows), rows.select(F.col("mention_id").alias("id"), K.compact_name(F.col("display_name")).alias("name")))


@query(
    D.with_views(
        "mention",
        sql=""", e AS (SELECT * FROM mention WHERE mention_id % 5 <> 0), i AS (SELECT * FROM mention WHERE mention_id % 5 = 0), void AS (SELECT github FROM e GROUP BY github HAVING count(DISTINCT display_name) > 1),
        pairs AS (SELECT i.mention_id AS i_id, e.mention_id AS e_id, i.display_name = e.display_name AS named, i.github = e.github AND i.github NOT IN (SELECT github FROM void) AS shared,
        i.github <> e.github AND i.github NOT IN (SELECT github FROM void) AND e.github NOT IN (SELECT github FROM void) AS apart, CAST(i.city = e.city AS INT) + CAST(i.company = e.company AS INT) AS context
        FROM i JOIN e ON i.display_name = e.display_name OR i.github = e.github), s AS (SELECT *, (named AND apart AND NOT shared) OR (NOT named AND shared) AS clash, CASE WHEN named AND shared THEN 0.99 WHEN named AND context >= 2 THEN 0.89 WHEN named THEN 0.7 + 0.1 * context END AS score FROM pairs WHERE named OR shared),
        best AS (SELECT i_id, arg_max(e_id, (score, -e_id)) AS e_id, max(score) AS score FROM s WHERE NOT clash GROUP BY i_id), worst AS (SELECT i_id, min(e_id) AS e_id FROM s WHERE clash GROUP BY i_id)
        SELECT i.mention_id AS id, CASE WHEN best.score >= 0.9 THEN 'merge' WHEN best.score IS NOT NULL THEN 'review' WHEN worst.e_id IS NOT NULL THEN 'review' ELSE 'new' END AS decision, round(CAST(coalesce(best.score, 0.0) AS DOUBLE), 3) AS confidence, coalesce(best.e_id, worst.e_id) AS matched_id,
        CASE WHEN best.score >= 0.9 THEN 'exact_key' WHEN best.score IS NOT NULL THEN 'review' WHEN worst.e_id IS NOT NULL THEN 'conflict' ELSE 'new' END AS method FROM i LEFT JOIN best ON best.i_id = i.mention_id LEFT JOIN worst ON worst.i_id = i.mention_id""",
    )
)
def resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the mentions resolved against the others as known people."""
    rows = D.mentions(spark, sf_dir)
    incoming, existing = rows.filter("mention_id % 5 = 0"), rows.filter("mention_id % 5 <> 0")
    return R.resolved(_people(incoming), _people(existing), _handles(incoming), _handles(existing))


@query(D.with_views("mention", sql=f"SELECT mention_id AS id, canonical FROM (SELECT mention_id, min(mention_id) OVER w AS canonical, count(*) OVER w AS n FROM mention WHERE github NOT IN ({_WITHDRAWN}) WINDOW w AS (PARTITION BY github)) WHERE n > 1"))
def merged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People that identifying handles make one, with the id that stays."""
    rows = D.mentions(spark, sf_dir)
    return R.merges(_people(rows), _handles(rows))


_MAPPED = "SELECT o_orderkey AS opportunity_id, o_custkey - o_custkey % 3 AS founder_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 END AS company_id, CASE o_orderstatus WHEN 'O' THEN 'screening' WHEN 'F' THEN 'diligence' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'decided' END END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS decided_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS sector FROM orders"


@query(
    f"""SELECT founder_id, arg_min(opportunity_id, (created_at, opportunity_id)) AS opportunity_id, min(company_id) AS company_id, arg_min(status, (CASE status WHEN 'screening' THEN 0 WHEN 'diligence' THEN -1 ELSE -2 END, created_at, opportunity_id)) AS status, strftime(min(created_at), '%Y-%m-%d') AS created_on, strftime(min(decided_at), '%Y-%m-%d') AS decided_on,
    arg_min(sector, (created_at, opportunity_id)) FILTER (WHERE sector IS NOT NULL) AS sector, count(*) AS n_folded FROM ({_MAPPED}) GROUP BY founder_id, coalesce(CAST(company_id AS VARCHAR), 'deal-' || opportunity_id)"""
)
def folded_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals after every three founders became one."""
    orders = D.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "screening").when(F.col("o_orderstatus") == "F", "diligence").when(key % 2 == 0, "rejected").otherwise("decided")
    date = F.col("o_orderdate").cast("timestamp")
    deals = orders.select(
        key.alias("opportunity_id"), F.col("o_custkey").alias("founder_id"), F.when(key % 11 != 0, key % 7).alias("company_id"), status.alias("status"), date.alias("created_at"), F.when(F.col("o_orderstatus") == "F", date + F.expr("interval 3 days")).alias("decided_at"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("sector")
    )
    mapping = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical"))
    rows = M.fold_deals(M.rekeyed(deals, mapping))
    return rows.select("founder_id", "opportunity_id", "company_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), F.date_format("decided_at", "yyyy-MM-dd").alias("decided_on"), "sector", "n_folded")


@query(
    """WITH c AS (SELECT o_orderkey AS claim_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS survivor FROM orders)
    SELECT survivor AS claim_id, l_linenumber AS signal_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'refutes' ELSE 'supports' END AS stance, max(l_quantity / 50) AS weight, max(1 - l_tax) AS extraction_conf, string_agg(DISTINCT l_linestatus, ' | ' ORDER BY l_linestatus) AS rationale
    FROM lineitem JOIN c ON claim_id = l_orderkey GROUP BY survivor, l_linenumber"""
)
def folded_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after claims of one founder and key became one."""
    claims = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("founder_id"), F.col("o_orderpriority").alias("dedup_key"))
    evidence = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("signal_id"), F.when(F.col("l_returnflag") == "R", "refutes").otherwise("supports").alias("stance"), (F.col("l_quantity") / 50).alias("weight"), (1 - F.col("l_tax")).alias("extraction_conf"), F.col("l_linestatus").alias("rationale"))
    return M.fold_claims(claims, evidence)[1]


_KEYED = f"SELECT s_suppkey, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE words END, ' ') AS name_key FROM (SELECT *, list_filter(words, lambda w: w NOT IN ({_LEGAL})) AS kept FROM (SELECT *, regexp_extract_all(lower(name), '[a-z0-9]+') AS words FROM ({_SUFFIXED})))"


@query(f"WITH k AS (SELECT s_suppkey AS company_id, name_key FROM ({_KEYED}) UNION ALL SELECT s_suppkey + 1000000, name_key FROM ({_KEYED})) SELECT company_id, company_id % 1000000 + CASE WHEN company_id % 1000000 % 2 = 0 THEN 1000000 ELSE 0 END AS survivor FROM k")
def company_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company twice, under its plain and its legal name: the one with a deal stays, else the older."""
    rows = suffixed_companies(spark, sf_dir).select(F.col("s_suppkey").alias("company_id"), K.company_key(F.col("name")).alias("name_key"))
    plain = D.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("company_id"), K.company_key(F.col("s_name")).alias("name_key"))
    both = rows.unionByName(plain).withColumn("has_deal", (F.col("company_id") >= 1000000) & (F.col("company_id") % 2 == 0)).withColumn("created_at", F.col("company_id"))
    return M.survivor_by_name(both)


@query(
    f"""WITH k AS ({_KEYED}), known AS (SELECT * FROM k WHERE s_suppkey % 2 = 0) SELECT k.s_suppkey AS mention_id, CASE WHEN known.s_suppkey IS NOT NULL THEN CAST(known.s_suppkey AS VARCHAR) ELSE 'new-' || substr(sha256(k.name_key), 1, 16) END AS company_id, CASE WHEN known.s_suppkey IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by FROM k LEFT JOIN known USING (name_key)"""
)
def resolved_company_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixed_companies(spark, sf_dir).select(F.col("s_suppkey").alias("mention_id"), K.company_key(F.col("name")).alias("name_key"), F.lit(None).cast("string").alias("domain"))
    known = D.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("company_id"), K.company_key(F.col("s_name")).alias("name_key"), F.lit(None).cast("string").alias("domain"))
    return M.resolved_companies(rows, known)
