"""Columns and aggregates of the trust and score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights of the scoring model.
DEFAULT_RELIABILITY, DEFAULT_CONFIDENCE, DEFAULT_RELEVANCE = 0.4, 0.7, 0.8
VERIFIED_AT, CONTRADICTED_AT, EXTERNAL_AT = 0.7, 0.4, 0.8
HALF_LIFE_DAYS, UNDATED_RECENCY, SATURATION, MOMENTUM_DAYS = 540.0, 0.6, 3.0, 180
CATEGORY_WEIGHT = {"research": 1.0, "traction": 1.0, "open_source": 0.9, "funding": 0.9, "achievement": 0.85, "technical_skill": 0.7, "employment": 0.6, "affiliation": 0.6, "education": 0.5, "media": 0.4}
CATEGORY_BUCKET = {"technical_skill": "tech", "open_source": "tech", "research": "tech", "achievement": "execution", "traction": "execution", "funding": "execution", "education": "pedigree", "employment": "pedigree", "affiliation": "pedigree", "media": "influence"}
BUCKETS = ("tech", "execution", "pedigree", "influence")
OTHER_WEIGHT, OTHER_BUCKET = 0.5, "execution"


def lookup(key: Column, table: dict, default) -> Column:
    """A small fixed mapping as an expression, so that no join is planned for it."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(entries, key), F.lit(default))


def evidence_weight(reliability: Column, confidence: Column, relevance: Column) -> Column:
    """How much one piece of evidence weighs, 0 to 1; what is missing takes its default."""
    product = F.coalesce(reliability, F.lit(DEFAULT_RELIABILITY)) * F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)) * F.coalesce(relevance, F.lit(DEFAULT_RELEVANCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))


def any_of(weight: Column, where: Column | None = None) -> Column:
    """Aggregate: the chance that at least one of independent weights holds (noisy-OR); 0 for none. Null weights do not
    count."""
    miss = F.lit(1.0) - (weight if where is None else F.when(where, weight))
    return F.lit(1.0) - F.coalesce(F.product(miss), F.lit(1.0))


def status(trust: Column, strongest_refutation: Column) -> Column:
    return F.when(F.coalesce(strongest_refutation, F.lit(0.0)) >= CONTRADICTED_AT, "contradicted").when(trust >= VERIFIED_AT, "verified").otherwise("unverified")


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def recency(at: Column, as_of: Column) -> Column:
    """Halves every HALF_LIFE_DAYS; 1 for the future, a fixed value for unknown dates."""
    return F.when(at.isNull(), UNDATED_RECENCY).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(at, as_of)) / HALF_LIFE_DAYS))


def rounded(x: Column, digits: int) -> Column:
    """A non-negative number rounded half up; what lies within a millionth of a half counts as one, so that the order of
    a product's factors does not show."""
    return F.floor(x * 10**digits + (0.5 + 1e-6)) / 10**digits


def saturated(x: Column) -> Column:
    return F.round(100 * (1 - F.exp(-x / SATURATION)), 1)
