"""Claims: evidence edges, trust, founder scores, minting and score history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .graph import stored

#: Fixed value: the claim categories.
CATEGORIES = sorted(S.CATEGORY_WEIGHT)


def fold_evidence(raw: DataFrame) -> DataFrame:
    """One edge per (claim, signal): a refutation wins over support, the largest weight and the first source stay.

    Partial aggregation keeps what is shuffled to one row per pair and task."""
    weight = S.evidence_weight(F.col("reliability"), F.col("confidence"), F.col("relevance"))
    return raw.groupBy("claim_id", "signal_id").agg(
        F.when(F.bool_or(F.col("stance") == "refutes"), "refutes").otherwise("supports").alias("stance"), F.max(weight).alias("weight"), F.min("source").alias("source")
    )


def trust(evidence: DataFrame) -> DataFrame:
    """Per claim the trust score, what it is made of and its status. Claims without evidence are not in the result."""
    supports, refutes = F.col("stance") == "supports", F.col("stance") == "refutes"
    found = evidence.groupBy("claim_id").agg(
        S.any_of(F.col("weight"), supports).alias("_support"), S.any_of(F.col("weight"), refutes).alias("_refute"), F.count_if(supports).alias("corroboration_n"), F.count_if(refutes).alias("refutation_n"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.coalesce(F.bool_or(F.when(supports, F.col("weight") >= S.EXTERNAL_AT)), F.lit(False)).alias("external_verified"), F.max(F.when(refutes, F.col("weight"))).alias("_strongest"),
    )
    score = S.rounded(F.col("_support") * (1 - F.col("_refute")), 4)
    return found.select("claim_id", score.alias("trust"), S.rounded(F.col("_support"), 4).alias("support"), S.rounded(F.col("_refute"), 4).alias("refute"), "corroboration_n", "refutation_n", "sources", "external_verified", S.status(score, F.col("_strongest")).alias("status"))


def contributions(claims: DataFrame, trusts: DataFrame, as_of: Column) -> DataFrame:
    """What each claim adds to its founder's score; claims without trust or impact add nothing."""
    x = F.coalesce("trust", F.lit(0.0)) * F.coalesce("impact", F.lit(0.0)) * S.lookup(F.col("category"), S.CATEGORY_WEIGHT, S.OTHER_WEIGHT) * S.recency(F.col("occurred_at"), as_of)
    recent = F.coalesce(F.floor(S.age_days(F.col("occurred_at"), as_of)) <= S.MOMENTUM_DAYS, F.lit(False))
    return claims.join(trusts.select("claim_id", "trust", "status"), "claim_id", "left").select("founder_id", "claim_id", "category", x.alias("x"), recent.alias("recent"), F.coalesce("status", F.lit("unverified")).alias("status"))


def founder_scores(parts: DataFrame) -> DataFrame:
    """Saturating score, the same per bucket, and the recent share; one row per founder with claims."""
    bucket = S.lookup(F.col("category"), S.CATEGORY_BUCKET, S.OTHER_BUCKET)
    sums = parts.groupBy("founder_id").agg(
        F.sum("x").alias("_total"), *(F.coalesce(F.sum(F.when(bucket == b, F.col("x"))), F.lit(0.0)).alias(f"_{b}") for b in S.BUCKETS), F.coalesce(F.sum(F.when(F.col("recent"), F.col("x"))), F.lit(0.0)).alias("_recent"),
        F.count("*").alias("n_claims"), F.count_if(F.col("status") == "verified").alias("n_verified"),
    )
    return sums.select("founder_id", S.saturated(F.col("_total")).alias("founder_score"), *(S.saturated(F.col(f"_{b}")).alias(b) for b in S.BUCKETS), F.when(F.col("_total") > 0, F.round(F.col("_recent") / F.col("_total"), 3)).otherwise(0.0).alias("momentum"), "n_claims", "n_verified")


def trust_changes(before: DataFrame, after: DataFrame, most: int = 15) -> DataFrame:
    """The claims whose trust or status changed, largest drops first; `most` is the report's length."""
    b = before.select("claim_id", F.col("trust").alias("trust_before"), F.col("status").alias("status_before"))
    a = after.select("claim_id", F.col("trust").alias("trust_after"), F.col("status").alias("status_after"))
    changed = b.join(a, "claim_id").filter(~(F.col("trust_before").eqNullSafe(F.col("trust_after")) & F.col("status_before").eqNullSafe(F.col("status_after"))))
    return changed.withColumn("delta", F.round(F.col("trust_after") - F.col("trust_before"), 4)).orderBy("delta", "claim_id").limit(most)


def moved_points(points: DataFrame) -> DataFrame:
    """Score points that differ from the founder's previous one; the first always counts."""
    w = Window.partitionBy("founder_id").orderBy("created_at", "point_id")
    return points.withColumn("previous", F.lag("score").over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("score").eqNullSafe(F.col("previous"))).drop("_n")


def score_summary(points: DataFrame) -> DataFrame:
    """Per founder the first and last score, their difference, count and range."""
    at = F.struct("created_at", "point_id")
    return points.groupBy("founder_id").agg(
        F.min_by("score", at).alias("first_score"), F.max_by("score", at).alias("last_score"), F.count("*").alias("n_points"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    ).withColumn("delta", F.round(F.col("last_score") - F.col("first_score"), 4))


def pending_founders(founders: DataFrame, attributions: DataFrame) -> DataFrame:
    """Founders with a signal newer than their cursor, or with signals and no cursor: one semi-join on an aggregate, so a
    founder of many signals costs one row."""
    latest = attributions.groupBy("founder_id").agg(F.max("ingested_at").alias("latest"))
    return founders.join(latest, "founder_id").filter(F.col("last_claimed_at").isNull() | (F.col("latest") > F.col("last_claimed_at"))).select("founder_id", F.when(F.col("last_claimed_at").isNull(), "cold").otherwise("warm").alias("path"))


def with_attributes(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim_id, attributes MAP<STRING, STRING>, impact) and (claim_id, occurred_at) of what supports them -> the claims with
    `impact` and `occurred_at`, the latest, among their attributes, in place of what an extractor called so. Null attributes are
    none; a claim of undated evidence has the key with a null."""
    latest = cited.groupBy("claim_id").agg(F.max("occurred_at").alias("_latest"))
    own = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("impact", "occurred_at"))
    added = F.create_map(F.lit("impact"), F.col("impact").cast("string"), F.lit("occurred_at"), F.date_format("_latest", "yyyy-MM-dd'T'HH:mm:ss"))
    return claims.join(latest, "claim_id", "left").withColumn("attributes", F.map_concat(own, added)).drop("_latest")


def valid(extracted: DataFrame) -> DataFrame:
    """Extracted claims of the taxonomy that say something."""
    return extracted.filter(F.col("category").isin(CATEGORIES) & (F.trim(F.coalesce("statement", F.lit(""))) != ""))


def mint(extracted: DataFrame, cited: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New claims and their evidence edges from extracted claims.

    `extracted`: founder_id, claim_no, statement, category, impact, dedup_key, supporting, refuting (arrays of positions);
    `cited`: founder_id, pos, signal_id, weight, occurred_at; `taken`: founder_id, dedup_key already in use. Claims outside
    the taxonomy, without a statement, or without a supporting position that exists are dropped; a claim's date is its
    latest support's. `attributes` (a map, if there is one) gains impact and date. The first claim of a founder keeps a
    dedup key, later ones and taken ones get none."""
    rows = valid(extracted)
    positions = F.concat(F.transform(F.coalesce("supporting", F.array().cast("array<int>")), lambda p: F.struct(p.alias("pos"), F.lit("supports").alias("stance"))), F.transform(F.coalesce("refuting", F.array().cast("array<int>")), lambda p: F.struct(p.alias("pos"), F.lit("refutes").alias("stance"))))
    cites = rows.select("founder_id", "claim_no", F.explode(positions).alias("c")).select("founder_id", "claim_no", "c.pos", "c.stance").join(cited, ["founder_id", "pos"])
    supports = F.col("stance") == "supports"
    # one edge per claim and signal, which also says whether the signal supports the claim anywhere; claims and edges both come from it
    found = stored(cites.groupBy("founder_id", "claim_no", "signal_id").agg(
        F.when(F.bool_or(F.col("stance") == "refutes"), "refutes").otherwise("supports").alias("stance"), F.max("weight").alias("weight"), F.bool_or(supports).alias("_supports"), F.max(F.when(supports, F.col("occurred_at"))).alias("_at")
    ))
    dated = found.groupBy("founder_id", "claim_no").agg(F.max("_at").alias("occurred_at"), F.count("*").alias("n_evidence"), F.bool_or("_supports").alias("_supports")).filter("_supports").drop("_supports")
    first = F.row_number().over(Window.partitionBy("founder_id", "dedup_key").orderBy("claim_no")) == 1
    claims = rows.join(dated, ["founder_id", "claim_no"]).withColumn("_first", first)
    claims = claims.join(taken.select("founder_id", "dedup_key").distinct().withColumn("_taken", F.lit(True)), ["founder_id", "dedup_key"], "left")
    claims = claims.withColumn("dedup_key", F.when(F.col("_first") & F.col("_taken").isNull(), F.col("dedup_key"))).drop("_first", "_taken", "supporting", "refuting")
    if "attributes" in claims.columns:
        more = F.create_map(F.lit("impact"), F.col("impact").cast("string"), F.lit("occurred_at"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"))
        own = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("impact", "occurred_at"))
        claims = claims.withColumn("attributes", F.map_concat(own, more))
    edges = found.drop("_supports", "_at").join(dated.select("founder_id", "claim_no"), ["founder_id", "claim_no"], "left_semi")
    return claims, edges


def routed(extracted: DataFrame, existing: DataFrame, decisions: DataFrame) -> DataFrame:
    """Extracted claims with where each goes, `claim_id` and `action`: to the claim of its dedup key (`by_key`), else to the one a
    reviewer's decision names within the same founder and category, else to a new one."""
    by_key = existing.filter("dedup_key is not null").select("founder_id", "dedup_key", F.col("claim_id").alias("by_key"))
    named = existing.select("founder_id", "category", F.col("claim_id").alias("by_decision"))
    decided = decisions.filter(F.col("action") == "match").select("founder_id", "claim_no", F.col("existing_claim_id").alias("by_decision"))
    out = extracted.join(by_key, ["founder_id", "dedup_key"], "left").join(decided, ["founder_id", "claim_no"], "left")
    # only claims that a decision names are looked up; where there are no decisions, this falls away when the query is planned
    known = named.join(decided.select("founder_id", "by_decision").distinct(), ["founder_id", "by_decision"], "left_semi").withColumn("_known", F.lit(True))
    out = out.join(known, ["founder_id", "category", "by_decision"], "left")
    target = F.coalesce("by_key", F.when(F.col("_known"), F.col("by_decision")))
    return out.select(*extracted.columns, "by_key", target.alias("claim_id"), F.when(target.isNull(), "mint").otherwise("attach").alias("action"))


def matched(extracted: DataFrame, existing: DataFrame, decisions: DataFrame) -> DataFrame:
    """Where each extracted claim goes, as `routed` finds it."""
    return routed(extracted, existing, decisions).select("founder_id", "claim_no", "claim_id", "action")
