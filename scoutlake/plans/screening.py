"""Queries over screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import screening as S
from ..registry import query
from ..sources import domain as D
from .claims import scores

_STEP = "SELECT founder_id, count(*) AS n_points, arg_max(coalesce(step, -1e9), (created_at, point_id)) AS step FROM (SELECT *, score - lag(score) OVER (PARTITION BY founder_id ORDER BY created_at, point_id) AS step FROM score_point) GROUP BY founder_id"

_AXIS = f"""SELECT f.founder_id, founder_score AS score, CASE WHEN founder_score >= 40 THEN 'bull' WHEN founder_score < 15 AND coalesce(m.n, 0) >= 6 THEN 'bear' ELSE 'neutral' END AS verdict,
        CASE WHEN coalesce(n_points, 0) < 2 THEN 'stable' WHEN step >= 1 THEN 'improving' WHEN step <= -1 THEN 'declining' ELSE 'stable' END AS trend, round(least(0.95, 1 - exp(-coalesce(mass, 0) / 5)), 2) AS confidence,
        concat_ws('; ', CASE WHEN founder_score IS NULL THEN 'no score' END, CASE WHEN coalesce(m.n, 0) < 6 AND coalesce(m.n, 0) > 0 THEN 'cold start' END, CASE WHEN coalesce(n_points, 0) < 2 THEN 'no history' END) AS gaps
        FROM (SELECT c_custkey AS founder_id FROM customer) f LEFT JOIN score USING (founder_id) LEFT JOIN (SELECT founder_id, count(*) AS n, sum(coalesce(trust, 0)) AS mass FROM claim LEFT JOIN trust USING (claim_id) GROUP BY founder_id) m USING (founder_id) LEFT JOIN ({_STEP}) USING (founder_id)"""


@query(
    D.with_views(
        "score", "score_point",
        sql=_AXIS,
    )
)
def founder_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    founders = D.founders(spark, sf_dir).select("founder_id").join(scores(spark, sf_dir).select("founder_id", "founder_score"), "founder_id", "left")
    trusted = D.claims(spark, sf_dir).join(C.trust(C.fold_evidence(D.raw_evidence(spark, sf_dir))).select("claim_id", "trust"), "claim_id", "left")
    return S.founder_axis(founders, trusted, D.score_points(spark, sf_dir))


_AXES = "SELECT o_orderkey AS opportunity_id, 'market' AS axis, CAST(o_orderkey % 37 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 3 = 0"
_UPDATE = "SELECT o_orderkey AS opportunity_id, 'market' AS axis, CAST(o_orderkey % 38 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 2 = 0"


@query(
    f"""SELECT opportunity_id, axis, coalesce(u.score, a.score) AS score, CASE WHEN u.score IS NULL THEN NULL WHEN a.score IS NULL THEN 'stable' WHEN u.score - a.score > 1 THEN 'improving' WHEN a.score - u.score > 1 THEN 'declining' ELSE 'stable' END AS trend
    FROM ({_AXES}) a FULL JOIN ({_UPDATE}) u USING (opportunity_id, axis)"""
)
def axis_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market axes after an update, with their trends."""
    orders = {"orders": D.table(spark, sf_dir, "orders")}
    old, new = (spark.sql(q.replace("FROM orders", "FROM {orders}"), **orders) for q in (_AXES, _UPDATE))
    return S.upserted_axes(old, new)


@query(
    D.with_views(
        "opportunity",
        sql=""", e AS (SELECT DISTINCT opportunity_id, l_linenumber AS claim_id FROM opportunity JOIN lineitem ON l_orderkey = opportunity_id),
        j AS (SELECT opportunity_id, opportunity_id % 8 AS n_claims, 0.25 + (opportunity_id % 3) * 0.3 AS confidence, opportunity_id % 3 AS v, unnest([1, 3, 99]) AS claim_id, unnest([0, 1, 2]) AS pos FROM opportunity)
        SELECT j.opportunity_id, CASE max(v) WHEN 0 THEN 'bull' WHEN 1 THEN 'neutral' ELSE 'bear' END AS verdict, round(CAST(CASE WHEN max(n_claims) < 6 THEN least(max(confidence), 0.5) ELSE max(confidence) END AS DOUBLE), 2) AS confidence,
        coalesce(string_agg(CAST(e.claim_id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE e.claim_id IS NOT NULL), '') AS claim_ids, count(e.claim_id) AS n_resolved, count(*) - count(e.claim_id) AS n_dropped FROM j LEFT JOIN e ON e.opportunity_id = j.opportunity_id AND e.claim_id = j.claim_id GROUP BY j.opportunity_id""",
    )
)
def idea_axis_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements that cite claims, held against the claims there are."""
    deals = D.opportunities(spark, sf_dir).select("opportunity_id")
    evidence = deals.join(D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("opportunity_id"), F.col("l_linenumber").alias("claim_id")), "opportunity_id")
    v = F.col("opportunity_id") % 3
    judged = deals.select("opportunity_id", F.when(v == 0, "survives_as_is").when(v == 1, "pivot_needed").otherwise("fails").alias("verdict"), (0.25 + v * 0.3).alias("confidence"), F.array(F.lit(1), F.lit(3), F.lit(99)).alias("cited"), (F.col("opportunity_id") % 8).alias("n_claims"))
    return S.anchored(judged, evidence)


@query(D.with_views("opportunity", sql="SELECT opportunity_id, sector, NOT (contains('urgent care', sector) OR contains(sector, 'urgent') OR contains('low', sector) OR contains(sector, 'low')) AND sector <> '' AS rejected FROM opportunity"))
def thesis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    industries = F.array(F.lit("Urgent"), F.lit("LOW"))
    return D.opportunities(spark, sf_dir).select("opportunity_id", "sector", S.thesis_rejects(F.col("sector"), industries).alias("rejected"))


@query(
    D.with_views(
        "opportunity",
        sql="""SELECT opportunity_id, CASE WHEN opportunity_id % 4 = 0 AND opportunity_id % 3 = 0 THEN 'decided' WHEN opportunity_id % 4 = 1 THEN 'rejected' WHEN opportunity_id % 8 = 2 THEN 'diligence' ELSE status END AS status, (opportunity_id % 4 = 0 AND opportunity_id % 3 <> 0) OR opportunity_id % 8 = 6 AS refused FROM opportunity""",
    )
)
def deal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions applied: unknown words and pursuits without an axis are refused."""
    deals = D.opportunities(spark, sf_dir)
    d = F.col("opportunity_id") % 4
    decisions = deals.filter(d != 3).select("opportunity_id", F.when(d == 0, "pursue").when(d == 1, "pass").when(F.col("opportunity_id") % 8 == 2, "track").otherwise("later").alias("decision"), D.as_of().alias("decided_at"))
    axes = deals.filter("opportunity_id % 3 = 0").select("opportunity_id")
    return S.decided(deals, decisions, axes).select("opportunity_id", "status", "refused")


def _founder_axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every deal's founder axis put in place; a third of the deals had one before, all have a market axis."""
    deals = D.opportunities(spark, sf_dir)
    old = [deals.filter(cond).select("opportunity_id", F.lit(axis).alias("axis"), F.lit(1.5).alias("score"), F.lit("neutral").alias("verdict"), F.lit("improving").alias("trend"), F.lit(0.5).alias("confidence"), F.lit("").alias("gaps")) for axis, cond in (("founder", "opportunity_id % 3 = 0"), ("market", "true"))]
    trust = C.trust(C.fold_evidence(D.raw_evidence(spark, sf_dir))).select("claim_id", "trust")
    claims = D.claims(spark, sf_dir).select("founder_id", "claim_id").join(trust, "claim_id", "left")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    signals = D.table(spark, sf_dir, "lineitem").select(k.alias("signal_id"), F.when(k % 4 != 0, F.concat(F.lit("https://e.test/"), (k % 30).cast("string"))).alias("url")).distinct()
    return S.upserted_founder_axes(deals, old[0].unionByName(old[1]), scores(spark, sf_dir), claims, D.score_points(spark, sf_dir), D.raw_evidence(spark, sf_dir), signals)


@query(
    D.with_views(
        "score", "score_point", "opportunity",
        sql=f"""SELECT opportunity_id, 'founder' AS axis, score, verdict, trend, confidence, gaps FROM opportunity JOIN ({_AXIS}) USING (founder_id)
        UNION ALL SELECT opportunity_id, 'market', 1.5, 'neutral', 'improving', 0.5, '' FROM opportunity""",
    )
)
def founder_axes_of_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes of all deals after the founder axis was computed and upserted."""
    return _founder_axes(spark, sf_dir)[0]


@query(
    D.with_views(
        "trust", "claim", "opportunity",
        sql="""SELECT opportunity_id, claim_id, trust, url FROM opportunity JOIN claim USING (founder_id) LEFT JOIN trust USING (claim_id)
        LEFT JOIN (SELECT DISTINCT l_orderkey AS claim_id, 'https://e.test/' || ((l_orderkey * 10 + l_linenumber) % 30) AS url FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey * 10 + l_linenumber) % 4 <> 0) USING (claim_id)""",
    )
)
def founder_axis_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims and different pages that each deal's founder axis rests on."""
    return _founder_axes(spark, sf_dir)[1]
