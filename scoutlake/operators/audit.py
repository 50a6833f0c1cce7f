"""Data-quality invariants: one DataFrame of offending rows per check, and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words the place resolver can give, and those that mean the gazetteer matched.
QUALITIES = ["exact", "alias", "inferred", "prior", "unverified", "country_only", "unknown"]
MATCHED = ["exact", "alias", "inferred", "prior"]


@dataclass(frozen=True)
class Check:
    name: str
    rows: DataFrame
    severity: str = "invariant"
    of: DataFrame | None = None
    where: Column | None = None


def each(name: str, of: DataFrame, where: Column | str, key: str) -> Check:
    """A check that looks at one row at a time: all such checks of a table are counted in one pass over it."""
    where = F.expr(where) if isinstance(where, str) else where
    return Check(name, of.filter(where).select(key), of=of, where=where)


def twice(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def several(rows: DataFrame, key: list[str], other: str) -> DataFrame:
    """Keys that come with more than one value of another column."""
    return rows.groupBy(*key).agg(F.count_distinct(F.col(other)).alias("n")).filter("n > 1")


def handles(identities: DataFrame, *kinds: str) -> DataFrame:
    """Wide identities as (founder_id, kind, value)."""
    return identities.unpivot("founder_id", list(kinds), "kind", "value").filter("value is not null and trim(value) <> ''")


def checks(t: dict[str, DataFrame]) -> list[Check]:
    """All checks over the tables signal, founder_signal, founder, identity, review, company, founder_company, opportunity,
    claim and claim_evidence. Checks that look at single rows share a pass over their table; those that group by different
    keys stay separate, so that each names its rows."""
    founder, identity, signal = t["founder"], t["identity"], t["signal"]
    long = handles(identity, "github", "linkedin", "twitter", "orcid")
    ids = founder.select(F.col("founder_id").alias("counterpart_founder_id"))
    name = F.lower(F.trim("display_name"))
    return [
        Check("signal: (source, external_id) unique", twice(signal, "source", "external_id")),
        Check("signal: canonical_url unique per source", twice(signal.filter("canonical_url is not null"), "source", "canonical_url")),
        each("signal: kind is set", signal, "kind is null", "signal_id"),
        Check("signal: market artifacts carry no attribution", signal.filter("kind = 'market'").join(t["founder_signal"], "signal_id").select("signal_id")),
        Check("founder_signal: one edge per pair", twice(t["founder_signal"], "founder_id", "signal_id")),
        Check("identity: handles of several founders", several(long.withColumn("value", F.lower("value")), ["kind", "value"], "founder_id"), "warning"),
        Check("founder: no name twins in one place", twice(founder.filter("display_name is not null").select(name.alias("name"), "city_geonameid"), "name", "city_geonameid")),
        each("founder: persons only", founder, F.col("display_name").rlike("[0-9]") | ~F.col("display_name").rlike(r"\s") | F.lower("display_name").rlike(r"(hackathon|makeathon|gmbh|ltd|inc\.?$|university|institute)"), "founder_id"),
        Check("place: one id per city key", several(founder.filter("city_key is not null"), ["city_key"], "city_geonameid")),
        Check("place: one name per id", several(founder.filter("city_geonameid is not null"), ["city_geonameid"], "city")),
        each("place: a city has its country", founder, "city_geonameid is not null and country_code is null", "founder_id"),
        each("place: a matched city has its id", founder, F.col("location_quality").isin(MATCHED) & F.col("city_geonameid").isNull(), "founder_id"),
        each("place: country_only names a country", founder, "location_quality = 'country_only' and country_code is null", "founder_id"),
        Check("place: known quality words", founder.filter(F.col("location_quality").isNotNull() & ~F.col("location_quality").isin(QUALITIES)).select("location_quality").distinct()),
        Check("identity: one ORCID, one founder", several(identity.filter("orcid is not null").withColumn("orcid", F.lower("orcid")), ["orcid"], "founder_id")),
        Check("identity: values are canonical", handles(identity, "github", "linkedin", "twitter").filter((F.col("value") != F.lower("value")) | F.col("value").contains("/") | F.col("value").contains(".com") | F.col("value").startswith("@") | (F.trim("value") != F.col("value")))),
        Check("review: the counterpart exists", t["review"].filter("counterpart_founder_id is not null").join(ids, "counterpart_founder_id", "left_anti").select("review_id")),
        each("review: nobody is their own counterpart", t["review"], "counterpart_founder_id = founder_id", "review_id"),
        Check("company: name_key unique", twice(t["company"].filter("name_key is not null"), "name_key")),
        Check("company: domain unique", twice(t["company"].filter("domain is not null"), "domain")),
        Check("founder_company: one edge per pair", twice(t["founder_company"], "founder_id", "company_id")),
        each("opportunity: has a founder", t["opportunity"], "founder_id is null", "opportunity_id"),
        each("opportunity: a named venture has its company", t["opportunity"], "company_name is not null and company_id is null", "opportunity_id"),
        Check("opportunity: one deal per founder and company", twice(t["opportunity"].filter("company_id is not null"), "founder_id", "company_id")),
        Check("claim: dedup_key unique per opportunity", twice(t["claim"].filter("dedup_key is not null and opportunity_id is not null"), "opportunity_id", "dedup_key")),
        Check("claim_evidence: one edge per triple", twice(t["claim_evidence"], "claim_id", "signal_id", "stance")),
    ]


def summary(found: list[Check]) -> DataFrame:
    """(check, severity, violations), one row each; the counts run as one job."""
    out = None
    grouped: dict[int, list[Check]] = {}
    for c in found:
        if c.of is not None:
            grouped.setdefault(id(c.of), []).append(c)
    parts = [c.rows.agg(F.count("*").alias("violations")).select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "violations") for c in found if c.of is None]
    for checks_of in grouped.values():
        counts = checks_of[0].of.agg(*(F.count_if(F.coalesce(c.where, F.lit(False))).alias(f"n{i}") for i, c in enumerate(checks_of)))
        rows = F.explode(F.array(*(F.struct(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), F.col(f"n{i}").alias("violations")) for i, c in enumerate(checks_of))))
        parts.append(counts.select(rows.alias("r")).select("r.*"))
    for one in parts:
        out = one if out is None else out.unionByName(one)
    return out
