"""A delivery of found people: assembly, gates, attribution, enrichment, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .ingest import first_of_each
from .ranks import ranked

#: Fixed value: references to profiles within page text.
PROFILE_IN_TEXT = r"(?i)https?://[^\s\"'<>)\]}]+|(?:www\.)?(?:github|linkedin|twitter|x)\.com/[^\s\"'<>)\]}]+"


def mined_profiles(pages: DataFrame) -> DataFrame:
    """(founder_id, text) -> (founder_id, kind, value): the first acceptable reference of each kind in a page's text."""
    found = pages.select("founder_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PROFILE_IN_TEXT), F.lit(0))).alias("pos", "raw"))
    kind = F.when(F.lower("raw").contains("github.com"), "github").when(F.lower("raw").contains("linkedin."), "linkedin").when(F.lower("raw").rlike(r"(^|[/.])(twitter|x)\.com"), "twitter").when(F.lower("raw").contains("orcid.org"), "orcid")
    parsed = found.withColumn("kind", kind).filter("kind is not null").withColumn("value", K.parse_identity(F.col("kind"), F.regexp_replace("raw", r"[.,;:]+$", ""))["value"]).filter("value is not null")
    return parsed.groupBy("founder_id", "kind").agg(F.min_by("value", "pos").alias("value"))


def first_identities(own: DataFrame, urls: DataFrame) -> DataFrame:
    """(founder_id, kind, raw) and (founder_id, pos, url) -> the first value that identifies a person, the own one before
    those of the founder's artifacts."""
    kinds = F.explode(F.array(*map(F.lit, K.STRONG_KINDS)))
    tried = own.select("founder_id", "kind", F.lit(-1).alias("pos"), "raw").unionByName(urls.select("founder_id", kinds.alias("kind"), "pos", F.col("url").alias("raw")))
    parsed = tried.withColumn("value", K.parse_identity(F.col("kind"), F.col("raw"))["value"]).filter("value is not null")
    return parsed.groupBy("founder_id", "kind").agg(F.min_by("value", "pos").alias("value"))


def assembled(signals: DataFrame, strong: DataFrame) -> DataFrame:
    """(founder_id, url, source, pos) and the founders' strong identities -> signals once per canonical URL with their
    attribution confidence, and the founder's discovery confidence and status."""
    once = first_of_each(signals.withColumn("canonical_url", K.canonical_url(F.col("url"))), ["founder_id", "canonical_url"], ["pos"])
    n = once.groupBy("founder_id").agg(F.count("*").alias("n_signals"))
    kinds = strong.groupBy("founder_id").agg(F.count_distinct("kind").alias("n_strong"))
    rows = n.join(kinds, "founder_id", "left").withColumn("n_strong", F.coalesce("n_strong", F.lit(0)))
    confidence = F.round(F.least(F.lit(0.95), F.lit(0.4) + F.col("n_signals") * 0.1 + F.when(F.col("n_strong") > 0, 0.2).otherwise(0.0)), 2)
    return rows.select("founder_id", "n_signals", "n_strong", confidence.alias("discovery_confidence"), F.when(F.col("n_strong") > 0, 0.9).otherwise(0.7).alias("attribution_confidence"), F.when(F.col("n_signals") > 0, "discovered").otherwise("lead").alias("status"))


def gated(people: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People that pass as persons with evidence, and the counts of those that do not, by reason."""
    has = signals.select("founder_id").distinct().withColumn("_has", F.lit(True))
    rows = people.join(has, "founder_id", "left").withColumn("reason", F.when(~K.is_person(F.col("display_name")), "not_a_person").when(F.col("_has").isNull(), "no_evidence")).drop("_has")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def reject_counts(identities: DataFrame) -> DataFrame:
    """(kind, rejected) -> how often each kind was rejected for which reason."""
    return identities.filter("rejected is not null").groupBy("kind", F.col("rejected").alias("reason")).agg(F.count("*").alias("n"))


def enriched(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known founders after a delivery: the larger discovery confidence, and empty fields filled from it, the earliest
    mention first."""
    fields = ("city", "occupation", "current_company")
    filled = incoming.groupBy("founder_id").agg(F.max("discovery_confidence").alias("_confidence"), *(F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("mention_id"))).alias(f"_{c}") for c in fields))
    out = known.join(filled, "founder_id", "left")
    out = out.withColumn("discovery_confidence", F.greatest("discovery_confidence", "_confidence"))
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), f"_{c}"))
    return out.select(known.columns)


def new_handles(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Handles (founder_id, kind, value) that founders lack so far."""
    return incoming.select("founder_id", "kind", "value").distinct().join(held, ["founder_id", "kind", "value"], "left_anti")


def placed_mentions(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each mention's founder after resolution: merged and reviewed ones attach, new and conflicting ones make a founder
    of their own with an id that depends on the mention alone."""
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16))
    attach = F.col("decision").isin("merge", "review") & (F.col("method") != "conflict")
    return mentions.join(decisions, "id").select("id", F.when(attach, F.col("matched_id").cast("string")).otherwise(fresh).alias("founder_id"), (~attach).alias("created"), (F.col("decision") == "review").alias("flagged"), "method")


def run_metrics(source: str, counts: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One ledger row of a run: when, and how many rows each of its results has."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.agg(*(F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in counts)).select(F.lit(source).alias("source"), as_of.alias("finished_at"), *counts)


def trace_rows(edges: DataFrame, step: str, size: int = 1000) -> DataFrame:
    """A ledger row per founder: what the step did and on which evidence. Every row's evidence is complete: a founder with
    more ids than `size` has them in several numbered rows, so that none is unbounded."""
    numbered = ranked(edges.select("founder_id", "signal_id").distinct(), ["founder_id"], ["signal_id"]).withColumn("part", F.floor((F.col("position") - 1) / size).cast("int"))
    per = numbered.groupBy("founder_id", "part").agg(F.sort_array(F.collect_list("signal_id")).alias("evidence"), F.count("*").alias("n"))
    return per.select("founder_id", "part", F.lit(step).alias("step"), F.to_json(F.struct("n")).alias("summary"), "evidence")


def duplicate_groups(people: DataFrame) -> DataFrame:
    """Name keys that several people have, with how many and the earliest."""
    keyed = people.select("id", K.compact_name(F.col("display_name")).alias("name")).filter("name <> ''")
    return keyed.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def orphans(founders: DataFrame, attributions: DataFrame, signals: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Founders without signals, and founder signals without attribution that no claim cites."""
    bare = founders.join(attributions.select("founder_id"), "founder_id", "left_anti")
    loose = signals.filter("kind = 'founder'").join(attributions.select("signal_id"), "signal_id", "left_anti").join(cited.select("signal_id"), "signal_id", "left_anti")
    return bare, loose


def cached_institutions(strings: DataFrame, cache: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_name) affiliations -> resolved ones, and the new cache rows, misses included, so that no string is looked up
    twice. `cache`: alias_key, ror_id (null for a miss); `registry`: alias_key, ror_id, chosen."""
    keyed = strings.withColumn("alias_key", K.institution_key(F.col("raw_name"))).filter("alias_key is not null")
    unknown = keyed.select("alias_key").distinct().join(cache.select("alias_key"), "alias_key", "left_anti")
    chosen = registry.filter("chosen").groupBy("alias_key").agg(F.min("ror_id").alias("ror_id"))
    fresh = unknown.join(chosen, "alias_key", "left").select("alias_key", "ror_id")
    return keyed.join(cache.select("alias_key", "ror_id").unionByName(fresh), "alias_key", "left"), fresh


def institution_counts(education: DataFrame, aliases: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(founder_id, school) -> how often each affiliation string comes, and the `most` institutions with the most (the
    report's length). `aliases`: alias_key, ror_id (null for a miss)."""
    schools = education.select(F.trim(F.coalesce("school", F.lit(""))).alias("school")).filter("school <> ''")
    strings = schools.groupBy("school").agg(F.count("*").alias("n"))
    met = strings.withColumn("alias_key", K.institution_key(F.col("school"))).join(aliases.filter("ror_id is not null"), "alias_key")
    return strings, met.groupBy("ror_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ror_id").limit(most)


def cleanup(people: DataFrame, canonical: DataFrame, attributions: DataFrame, signals: DataFrame, cited: DataFrame, opportunities: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What a cleanup takes out, in its order, and the report of it as (metric, n): founders that are no persons; duplicates
    merged into `canonical` (id, canonical); founders left without signals; founder signals that nothing uses; and deals
    without a founder, which are only reported.

    `people`: founder_id, display_name; `attributions`: founder_id, signal_id; `signals`: signal_id, kind."""
    from .merge import rekeyed

    odd = people.filter(~K.is_person(F.col("display_name"))).select("founder_id")
    left = people.join(odd, "founder_id", "left_anti")
    mapping = canonical.join(left.select(F.col("founder_id").alias("id")), "id", "left_semi").join(left.select(F.col("founder_id").alias("canonical")), "canonical", "left_semi")
    gone = mapping.filter("id <> canonical").select(F.col("id").alias("founder_id"))
    left = left.join(gone, "founder_id", "left_anti")
    edges = rekeyed(attributions.join(odd, "founder_id", "left_anti"), mapping).distinct()
    bare, loose = orphans(left, edges, signals, cited)
    taken = {"non_persons": odd, "merged": gone, "without_signals": bare.select("founder_id"), "orphaned_signals": loose.select("signal_id"), "deals_without_founder": opportunities.filter("founder_id is null").select("opportunity_id")}
    before = {"duplicate_groups_before": duplicate_groups(people.withColumnRenamed("founder_id", "id")), "remaining_founders": left.join(bare.select("founder_id"), "founder_id", "left_anti"), "duplicate_groups_left": duplicate_groups(left.join(bare.select("founder_id"), "founder_id", "left_anti").withColumnRenamed("founder_id", "id"))}
    report = None
    for name, rows in (taken | before).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        report = one if report is None else report.unionByName(one)
    return taken, report
