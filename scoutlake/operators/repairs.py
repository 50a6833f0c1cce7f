"""Batch repairs of older tables, each a snapshot in and a snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import ledger as L


def backfilled_edges(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Attribution edges for signals that still name their founder in the row; existing edges are never overwritten."""
    legacy = signals.filter("founder_id is not null").select("founder_id", "signal_id", F.lit(1.0).alias("confidence"), F.lit("legacy").alias("method"))
    return legacy.join(edges.select("founder_id", "signal_id"), ["founder_id", "signal_id"], "left_anti")


def lost_without_column(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Attributions that would vanish with the legacy column: empty before it may be dropped."""
    return signals.filter("founder_id is not null").select("founder_id", "signal_id").join(edges, ["founder_id", "signal_id"], "left_anti")


def sole_owners(edges: DataFrame) -> DataFrame:
    """The founder of each signal that has exactly one, for the way back."""
    return edges.groupBy("signal_id").agg(F.count_distinct("founder_id").alias("n"), F.min("founder_id").alias("founder_id")).filter("n = 1").drop("n")


def with_kind(signals: DataFrame, edges: DataFrame) -> DataFrame:
    """Signals with their kind: founder where someone is attributed, else market; `diverged` marks market sources that
    have an attribution all the same."""
    owned = edges.select("signal_id").distinct().withColumn("_owned", F.lit(True))
    rows = signals.join(owned, "signal_id", "left")
    return rows.withColumn("kind", F.when(F.col("_owned"), "founder").otherwise("market")).withColumn("diverged", F.coalesce(F.col("_owned") & (F.col("signal_type") == "market_research"), F.lit(False))).drop("_owned")


def canonical_identities(identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(founder_id, kind, value) -> the canonical rows, and counts of what was kept, rewritten or cleared per kind."""
    rows = identities.withColumn("now", K.parse_identity(F.col("kind"), F.col("value"))["value"])
    outcome = F.when(F.col("now").isNull(), "cleared").when(F.col("now") != F.col("value"), "rewritten").otherwise("kept")
    counts = rows.groupBy("kind", outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return rows.filter("now is not null").select("founder_id", "kind", F.col("now").alias("value")).distinct(), counts


def repaired_identities(identities: DataFrame, path: str) -> dict[str, int]:
    """(identity_id, founder_id, kind, value) -> the canonical rows written to `path`, and how many of each kind were kept,
    rewritten or cleared. The constraints of the new table are part of the writing pass: an ORCID on two rows, or a handle
    on two rows of one founder, stops the job, and nothing is committed.

    Rows that become one value count before they meet, so `Ada` and `ada` of one founder are two rows and refused."""
    rows = identities.filter("value is not null").withColumn("now", K.parse_identity(F.col("kind"), F.col("value"))["value"])
    outcome = F.when(F.col("now").isNull(), "cleared").when(F.col("now") != F.col("value"), "rewritten").otherwise("kept")
    rows = rows.withColumn("outcome", outcome)
    seen = L.Observation()
    kinds = {f"{k}_{o}": F.count_if((F.col("kind") == k) & (F.col("outcome") == o)) for k in K.STRONG_KINDS for o in ("kept", "rewritten", "cleared")}
    rows = rows.observe(seen, *(c.alias(name) for name, c in kinds.items())).filter("now is not null")
    scope = F.when(F.col("kind") != "orcid", F.col("founder_id"))  # none: unique among all founders
    met = rows.groupBy("kind", scope.alias("_scope"), F.lower("now").alias("_same")).agg(F.count("*").alias("_n"), F.min(F.struct("identity_id", "founder_id", "now")).alias("r"))
    fault = F.concat(F.lit("one "), "kind", F.lit(" on "), F.col("_n").cast("string"), F.lit(" identity rows: "), "r.now")
    checked = met.select("r.identity_id", "r.founder_id", "kind", F.when(F.col("_n") > 1, F.raise_error(fault)).otherwise(F.col("r.now")).alias("value"))
    checked.write.parquet(path)
    return {name: int(seen.get.get(name) or 0) for name in kinds}


def lookalike_handles(identities: DataFrame, urls: DataFrame) -> DataFrame:
    """Handles that only another site's URL structure explains: some URL of the founder has them as a path segment on a
    host that merely contains the profile site's name, and none on the site itself."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1)), r"^www\.", "")
    known = F.when(F.col("kind") == "twitter", host.rlike(r"(^|\.)(x|twitter)\.com$")).when(F.col("kind") == "github", host.rlike(r"(^|\.)github\.com$")).otherwise(host.rlike(r"(^|\.)linkedin\."))
    alike = F.when(F.col("kind") == "twitter", host.rlike(r"(x|twitter)\.com$")).when(F.col("kind") == "github", host.contains("github.com")).otherwise(host.contains("linkedin"))
    segments = F.transform(F.split(F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: F.lower(s))
    met = identities.join(urls, "founder_id").filter(F.array_contains(segments, F.col("value")))
    flags = met.groupBy("founder_id", "kind", "value").agg(F.bool_or(known).alias("real"), F.bool_or(alike & ~known).alias("alike"))
    return flags.filter("alike and not real").select("founder_id", "kind", "value")


def changed(before: DataFrame, after: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of which any column differs between two snapshots, with both values."""
    a, b = (df.select(key, *(F.col(c).alias(f"{c}_{s}") for c in columns)) for df, s in ((before, "before"), (after, "after")))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    return a.join(b, key).filter(~same)
