"""Queries over texts for readers in bounded pieces, prose, websites, attributes, facets and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import claims as C
from ..operators import intake as N
from ..operators import screening as S
from ..operators import views as V
from ..operators.graph import shared_folder
from ..registry import query
from ..sources import domain as D
from ..sources import reference_data as B
from ..sources.domain import sql
from .claims import scores


@query(
    D.with_views(
        "claim",
        sql="""SELECT founder_id, chunk, '## Founder' || chr(10) || string_agg('[' || claim_id || '] (' || category || ', trust=None) claim ' || claim_id, chr(10) ORDER BY claim_id) AS block, count(*) AS n_claims
        FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY founder_id ORDER BY claim_id) - 1) / 12) AS INT) AS chunk FROM claim) GROUP BY founder_id, chunk""",
    )
)
def founder_claim_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each founder's claims for a reader, twelve a text."""
    claims = D.claims(spark, sf_dir).withColumn("trust", F.lit(None).cast("double")).withColumn("statement", F.concat_ws(" ", F.lit("claim"), F.col("claim_id").cast("string")))
    return S.claim_chunks(claims, "founder_id", "Founder")


_PAGES = "SELECT conv_id AS deck_id, turn AS page, text FROM conversations"


@query(
    f"""SELECT deck_id, chunk, string_agg('[deck p.' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page, text) AS block, count(*) AS n_pages
    FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY deck_id ORDER BY page, text) - 1) / 4) AS INT) AS chunk FROM ({_PAGES}) WHERE coalesce(text, '') <> '') GROUP BY deck_id, chunk"""
)
def deck_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each deck's pages for a reader, four a text, blank ones left out."""
    return N.page_chunks(sql(spark, sf_dir, _PAGES), 4)


# Sites as people write them: schemes and capitals, www, slashes, parameters in any order, tracking ones, none at all.
_SITES = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HTTP://WWW.Site' || p_size || '.test/Path/' || p_partkey || '/?b=2&trk=x&a=' || p_size WHEN 1 THEN ' www.site' || p_size || '.test/ ' WHEN 2 THEN 'https://site.test/a?trkInfo=' || p_partkey || '#top'
    WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN '  ' END ELSE 'site.test/a?z=' || p_partkey || '&empty=' END AS raw FROM part"""


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://site' || p_size || '.test/Path/' || p_partkey || '?a=' || p_size || '&b=2' WHEN 1 THEN 'https://site' || p_size || '.test' WHEN 2 THEN 'https://site.test/a' WHEN 4 THEN 'https://site.test/a?z=' || p_partkey END AS website FROM part""")
def website_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spelling for each site."""
    return sql(spark, sf_dir, _SITES).select("p_partkey", K.website(F.col("raw")).alias("website"))


@query("SELECT p_partkey, p_type || ', and' || ' ' || p_brand || '. [kept] ' || p_size AS prose FROM part")
def prose_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose without the claim ids cited in it, its spacing healed."""
    h = F.md5(F.col("p_partkey").cast("string"))
    one = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    cited = F.concat(F.col("p_type"), F.lit(" ["), one, F.lit("] , and  "), F.col("p_brand"), F.lit(" ("), one, F.lit("; "), F.upper(one), F.lit(" ) . [kept] "), F.col("p_size").cast("string"))
    return D.table(spark, sf_dir, "part").select("p_partkey", S.without_ids(cited).alias("prose"))


@query(
    """SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS n_attributes, CASE WHEN o_orderkey % 3 <> 0 THEN lower(o_orderstatus) END AS kind, '0.5' AS impact, strftime(latest, '%Y-%m-%dT%H:%M:%S') AS occurred_at
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS TIMESTAMP) AS latest FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
)
def claim_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose attributes say how much they matter and when what supports them last happened."""
    k = F.col("o_orderkey")
    given = F.when(k % 3 != 0, F.create_map(F.lit("kind"), F.lower("o_orderstatus"), F.lit("impact"), F.lit("high")))
    claims = D.table(spark, sf_dir, "orders").select(k.alias("claim_id"), given.alias("attributes"), F.lit(0.5).alias("impact"))
    cited = D.table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("claim_id"), F.col("l_shipdate").cast("timestamp").alias("occurred_at"))
    a = F.col("attributes")
    return C.with_attributes(claims, cited).select("claim_id", F.size(a).alias("n_attributes"), a["kind"].alias("kind"), a["impact"].alias("impact"), a["occurred_at"].alias("occurred_at"))


@query(D.with_views("signal", sql="SELECT signal_type, count(*) AS n FROM signal WHERE signal_type IS NOT NULL GROUP BY signal_type"))
def signal_type_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of signals a feed can be filtered by."""
    return V.facets(D.signals(spark, sf_dir), "signal_type")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS n_goals, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS n_sizes, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part")
def filled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records whose lists may be null, and scalars that may stay so."""
    k = F.col("p_partkey")
    rows = D.table(spark, sf_dir, "part").select(k, F.when(k % 3 != 0, F.array("p_type", "p_brand")).alias("goals"), F.when(k % 4 != 0, F.array("p_size")).alias("sizes"), F.when(k % 5 != 0, F.col("p_name")).alias("name"))
    return V.without_null_lists(rows).select("p_partkey", F.size("goals").alias("n_goals"), F.size("sizes").alias("n_sizes"), "name")


@query(
    D.with_views(
        "opportunity", "claim",
        sql="""SELECT opportunity_id, count(DISTINCT claim_id) AS n_citable, min(claim_id) AS first_claim FROM (SELECT opportunity_id, claim_id FROM opportunity JOIN claim USING (founder_id) WHERE sector <> ''
        UNION ALL SELECT opportunity_id, claim_id FROM opportunity JOIN claim ON claim_id % 3000 = opportunity_id WHERE sector <> '') GROUP BY opportunity_id""",
    )
)
def citable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that a judgement of a deal's idea may cite: its founder's and its market's, each once."""
    deals = D.opportunities(spark, sf_dir).withColumn("idea", F.lit(None).cast("string"))
    claims = D.claims(spark, sf_dir).select("claim_id", "founder_id", (F.col("claim_id") % 3000).alias("opportunity_id"), F.col("category").alias("statement"), "category", F.col("impact").alias("trust"))
    axes = deals.select("opportunity_id", F.lit("founder").alias("axis"), F.lit("").alias("verdict"), F.lit(0.0).alias("score"), F.lit("").alias("rationale")).limit(0)
    rows = S.evidence_for_idea(deals, claims, axes)[0].select("opportunity_id", "claim_id").distinct()
    return rows.groupBy("opportunity_id").agg(F.count("*").alias("n_citable"), F.min("claim_id").alias("first_claim"))


@query("SELECT c_custkey AS founder_id, c_name AS display_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'hop' END AS found_by FROM customer")
def found_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Researched people and those that their pages lead to, in one table; only the latter say how they were found."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("founder_id"), F.col("c_name").alias("display_name"))
    return c.filter("founder_id % 2 = 0").unionByName(c.filter("founder_id % 2 <> 0").withColumn("found_by", F.lit("hop")), allowMissingColumns=True)


@query(D.with_views("score", sql="SELECT founder_id, founder_score, n_claims FROM score"))
def reported_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of founder scores, written twice as JSON lines and read back: the second replaces the first."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    rows = scores(spark, sf_dir).select("founder_id", "founder_score", "n_claims")
    B.write_report(rows.limit(0), path)
    B.write_report(rows, path)
    return spark.read.schema(rows.schema).json(path)
