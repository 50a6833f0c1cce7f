"""Queries over claims, trust and founder scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import claims as C
from ..operators import incremental as I
from ..operators.graph import shared_folder
from ..registry import query
from ..sources import domain as D
from ..streaming import signals as T


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trust(C.fold_evidence(D.raw_evidence(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.founder_scores(C.contributions(D.claims(spark, sf_dir), _trust(spark, sf_dir), D.as_of()))


@query(D.with_views("score", sql="SELECT founder_id, display_name, founder_score, momentum, n_claims, n_verified FROM score JOIN (SELECT c_custkey AS founder_id, c_name AS display_name FROM customer) USING (founder_id)"))
def founder_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which founders score highest, and how many verified claims back each."""
    names = D.founders(spark, sf_dir).select("founder_id", "display_name")
    return scores(spark, sf_dir).join(names, "founder_id").select("founder_id", "display_name", "founder_score", "momentum", "n_claims", "n_verified").orderBy(F.desc_nulls_last("founder_score"), "founder_id")


@query(D.with_views("trust", sql="SELECT * FROM trust"))
def claim_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trust(spark, sf_dir)


@query(D.with_views("evidence", sql="SELECT claim_id, signal_id, stance, round(weight, 9) AS weight, source FROM evidence"))
def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fold_evidence(D.raw_evidence(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(D.with_views("score", sql="SELECT founder_id, founder_score, tech, execution, pedigree, influence, momentum FROM score"))
def founder_score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("founder_id", "founder_score", *S.BUCKETS, "momentum")


@query(
    D.with_views(
        "trust",
        sql="""SELECT claim_id, trust_before, status_before, trust AS trust_after, status AS status_after, round(trust - trust_before, 4) AS delta FROM (
        SELECT claim_id, floor((s * (1 - r)) * 10000 + 0.500001) / 10000 AS trust_before, CASE WHEN m >= 0.4 THEN 'contradicted' WHEN floor((s * (1 - r)) * 10000 + 0.500001) / 10000 >= 0.7 THEN 'verified' ELSE 'unverified' END AS status_before FROM (
        SELECT claim_id, 1 - coalesce(product(1 - w) FILTER (WHERE stance = 'supports'), 1) AS s, 1 - coalesce(product(1 - w) FILTER (WHERE stance = 'refutes'), 1) AS r, coalesce(max(w) FILTER (WHERE stance = 'refutes'), 0) AS m
        FROM (SELECT *, greatest(0.0, least(1.0, coalesce(reliability, 0.4) * coalesce(confidence, 0.7) * coalesce(relevance, 0.8))) AS w FROM raw_evidence) GROUP BY claim_id)) JOIN trust USING (claim_id)
        WHERE trust_before <> trust OR status_before <> status ORDER BY delta, claim_id LIMIT 15""",
    )
)
def trust_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What folding duplicate evidence edges does to trust: the fifteen largest drops."""
    raw = D.raw_evidence(spark, sf_dir)
    weight = S.evidence_weight(F.col("reliability"), F.col("confidence"), F.col("relevance"))
    return C.trust_changes(C.trust(raw.withColumn("weight", weight)), C.trust(C.fold_evidence(raw)))


@query(D.with_views("score_point", sql="""SELECT founder_id, point_id, score, previous FROM (SELECT *, lag(score) OVER w AS previous, row_number() OVER w AS n FROM score_point WINDOW w AS (PARTITION BY founder_id ORDER BY created_at, point_id)) WHERE n = 1 OR score <> previous"""))
def score_history_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.moved_points(D.score_points(spark, sf_dir)).select("founder_id", "point_id", "score", "previous")


@query(
    D.with_views(
        "score_point",
        sql="""SELECT founder_id, first_score, last_score, n_points, min_score, max_score, round(last_score - first_score, 4) AS delta FROM (SELECT founder_id, arg_min(score, (created_at, point_id)) AS first_score,
        arg_max(score, (created_at, point_id)) AS last_score, count(*) AS n_points, min(score) AS min_score, max(score) AS max_score FROM score_point GROUP BY founder_id)""",
    )
)
def score_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_summary(D.score_points(spark, sf_dir))


@query(
    D.with_views(
        "founder", "signal",
        sql="""SELECT f.founder_id, CASE WHEN f.last_claimed_at IS NULL THEN 'cold' ELSE 'warm' END AS path FROM (SELECT founder_id, CASE WHEN founder_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (founder_id % 40) END AS last_claimed_at FROM founder) f
        WHERE EXISTS (SELECT 1 FROM signal s WHERE s.founder_id = f.founder_id AND (f.last_claimed_at IS NULL OR s.ingested_at > f.last_claimed_at))""",
    )
)
def founders_pending_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = F.when(F.col("founder_id") % 3 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("founder_id") % 40).cast("int"))).alias("last_claimed_at")
    return C.pending_founders(D.founders(spark, sf_dir).select("founder_id", cursor), D.signals(spark, sf_dir).select("founder_id", "ingested_at"))


_EXTRACTED = """SELECT founder_id, claim_no, statement, category, dedup_key, p1, p2 FROM (SELECT o_custkey AS founder_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS claim_no,
    CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE 'claim of ' || o_orderpriority END AS statement, CASE WHEN o_orderkey % 23 = 0 THEN 'gossip' ELSE category END AS category, 'k' || (o_orderkey % 5) AS dedup_key,
    CAST(o_orderkey % 9 AS INT) AS p1, CAST(o_orderkey % 31 AS INT) AS p2 FROM orders JOIN (SELECT claim_id, category FROM claim) ON claim_id = o_orderkey)"""
_CITED = "SELECT founder_id, CAST(row_number() OVER (PARTITION BY founder_id ORDER BY signal_id) AS INT) AS pos, signal_id FROM signal"


@query(
    D.with_views(
        "claim", "signal",
        sql=f""", extracted AS ({_EXTRACTED}), cited AS ({_CITED}), valid AS (SELECT * FROM extracted WHERE category <> 'gossip' AND trim(statement) <> ''),
        edges AS (SELECT founder_id, claim_no, signal_id, bool_or(sup) AS sup FROM (SELECT founder_id, claim_no, p1 AS pos, true AS sup FROM valid UNION ALL SELECT founder_id, claim_no, p2, false FROM valid) JOIN cited USING (founder_id, pos) GROUP BY founder_id, claim_no, signal_id),
        kept AS (SELECT v.*, row_number() OVER (PARTITION BY founder_id, dedup_key ORDER BY claim_no) AS n FROM valid v WHERE EXISTS (SELECT 1 FROM edges e WHERE e.founder_id = v.founder_id AND e.claim_no = v.claim_no AND e.sup))
        SELECT k.founder_id, k.claim_no, k.category, (SELECT strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') FROM edges e JOIN signal USING (signal_id) WHERE e.founder_id = k.founder_id AND e.claim_no = k.claim_no AND e.sup) AS occurred_at, CASE WHEN n = 1 AND k.dedup_key <> 'k3' THEN k.dedup_key END AS dedup_key, (SELECT count(*) FROM edges e WHERE e.founder_id = k.founder_id AND e.claim_no = k.claim_no) AS n_evidence FROM kept k""",
    )
)
def minted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims minted from extractions that cite their founders' signals by position; key k3 is taken already."""
    from pyspark.sql import Window

    orders = D.table(spark, sf_dir, "orders").join(D.claims(spark, sf_dir).select(F.col("claim_id").alias("o_orderkey"), "category"), "o_orderkey")
    key = F.col("o_orderkey")
    extracted = orders.select(
        F.col("o_custkey").alias("founder_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("claim_no"), F.when(key % 19 == 0, "  ").otherwise(F.concat(F.lit("claim of "), "o_orderpriority")).alias("statement"),
        F.when(key % 23 == 0, "gossip").otherwise(F.col("category")).alias("category"), F.concat(F.lit("k"), (key % 5).cast("string")).alias("dedup_key"), F.array((key % 9).cast("int")).alias("supporting"), F.array((key % 31).cast("int")).alias("refuting"),
    )
    cited = D.signals(spark, sf_dir).select("founder_id", F.row_number().over(Window.partitionBy("founder_id").orderBy("signal_id")).alias("pos"), "signal_id", F.lit(0.5).alias("weight"), "occurred_at")
    taken = extracted.select("founder_id", F.lit("k3").alias("dedup_key")).distinct()
    claims, _ = C.mint(extracted, cited, taken)
    return claims.select("founder_id", "claim_no", "category", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "dedup_key", "n_evidence")


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """All evidence as a stream of landed files, a third of the signals each time, the first third once more with the last,
    and a first sight of every signal as weak support before; returns the folder of the state."""
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    raw = D.raw_evidence(spark, sf_dir)
    third = lambda k: raw.filter(F.pmod(F.xxhash64("signal_id"), F.lit(3)) == k)
    first_sight = third(1).withColumns({"stance": F.lit("supports"), "reliability": F.lit(0.0)})
    for k, rows in enumerate((third(0).unionByName(first_sight), third(1), third(2).unionByName(third(0)))):
        rows.write.parquet(f"{folder}/landed/{k}")
        stream = spark.readStream.schema(raw.schema).option("recursiveFileLookup", True).parquet(f"{folder}/landed")
        T.run_once(stream, I.writer(f"{folder}/state", D.claims(spark, sf_dir), D.as_of()), f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/state"


@query(D.with_views("score", sql="SELECT founder_id, founder_score, tech, execution, pedigree, influence, momentum, n_claims, n_verified FROM score"))
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founder scores kept by a stream of evidence in three batches, with repeats and edges that turn into refutations: the
    scores of one pass over all."""
    return I.scores(spark, _streamed(spark, sf_dir), D.claims(spark, sf_dir), D.as_of())


@query(D.with_views("trust", sql="SELECT claim_id, trust, support, refute, corroboration_n, refutation_n, external_verified, status FROM trust"))
def incremental_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust of claims as the same batches leave it."""
    return I.claim_trusts(spark, _streamed(spark, sf_dir)).drop("founder_id")
