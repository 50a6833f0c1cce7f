"""Survivorship: child rows move to canonical ids, and rows that become one are folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the order in which a deal's states outrank each other; the two outcomes are equal.
STATUS_RANK = {"screening": 0, "diligence": 1, "rejected": 2, "decided": 2}


def rekeyed(child: DataFrame, mapping: DataFrame, column: str = "founder_id") -> DataFrame:
    """`child` with ids of merged people replaced by canonical ones. Null ids stay."""
    m = mapping.select(F.col("id").alias(column), F.col("canonical").alias("_canonical"))
    return child.join(m, column, "left").withColumn(column, F.coalesce("_canonical", column)).select(child.columns)


def fold_edges(evidence: DataFrame) -> DataFrame:
    """Evidence edges of one (claim, signal): a refutation wins, weight and confidence take the largest, the different
    rationales join in order."""
    texts = F.array_sort(F.array_distinct(F.array_compact(F.collect_list("rationale"))))
    return evidence.groupBy("claim_id", "signal_id").agg(F.when(F.bool_or(F.col("stance") == "refutes"), "refutes").otherwise("supports").alias("stance"), F.max("weight").alias("weight"), F.max("extraction_conf").alias("extraction_conf"), F.array_join(texts, " | ").alias("rationale"))


def fold_claims(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of one founder and dedup key become the earliest of them; their evidence moves there and folds."""
    keyed = claims.filter("dedup_key is not null").groupBy("founder_id", "dedup_key").agg(F.min("claim_id").alias("survivor"))
    named = claims.join(keyed, ["founder_id", "dedup_key"], "left").withColumn("survivor", F.coalesce("survivor", "claim_id"))
    moved = evidence.join(named.select("claim_id", "survivor"), "claim_id").withColumn("claim_id", F.col("survivor")).drop("survivor")
    return named.filter("claim_id = survivor").drop("survivor"), fold_edges(moved)


def fold_deals(deals: DataFrame) -> DataFrame:
    """One deal per (founder, company): the furthest status (the earliest deal's of equal ones), the earliest times, and the first known value of the rest in
    order of creation. Deals without a company stay apart."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv)), F.col("status")), F.lit(-1))
    at = F.struct("created_at", "opportunity_id")
    key = F.coalesce(F.col("company_id").cast("string"), F.concat(F.lit("deal-"), F.col("opportunity_id").cast("string")))
    first_known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return deals.groupBy("founder_id", key.alias("_key")).agg(
        F.min_by("opportunity_id", at).alias("opportunity_id"), F.first("company_id").alias("company_id"), F.min_by("status", F.struct(-rank, "created_at", "opportunity_id")).alias("status"), F.min("created_at").alias("created_at"), F.min("decided_at").alias("decided_at"), first_known("sector"), F.count("*").alias("n_folded")
    ).drop("_key")


def fold_attributions(edges: DataFrame) -> DataFrame:
    at = F.struct("attributed_at", "method")
    return edges.groupBy("founder_id", "signal_id").agg(F.max("confidence").alias("confidence"), F.min("attributed_at").alias("attributed_at"), F.min_by("method", at).alias("method"))


def fold_identities(handles: DataFrame) -> DataFrame:
    return handles.filter("value is not null and trim(value) <> ''").select("founder_id", "kind", "value").distinct()


def survivor_by_name(companies: DataFrame) -> DataFrame:
    """(company_id, name_key, has_deal, created_at) -> (company_id, survivor): of one name key the company with a deal
    comes first, then the oldest."""
    order = F.struct(F.when(F.col("has_deal"), 0).otherwise(1), "created_at", "company_id")
    best = companies.filter("name_key is not null").groupBy("name_key").agg(F.min_by("company_id", order).alias("survivor"))
    return companies.join(best, "name_key", "left").select("company_id", F.coalesce("survivor", "company_id").alias("survivor"))


def resolved_companies(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(mention_id, name_key, domain) and (company_id, name_key, domain) -> the company by domain, else by name, else a new
    one per name key (or domain), named by a hash so that reruns agree."""
    by_domain = known.filter("domain is not null").groupBy("domain").agg(F.min("company_id").alias("_d"))
    by_name = known.filter("name_key is not null").groupBy("name_key").agg(F.min("company_id").alias("_n"))
    out = mentions.join(by_domain, "domain", "left").join(by_name, "name_key", "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.coalesce("name_key", "domain"), 256), 1, 16))
    found = F.coalesce(F.col("_d").cast("string"), F.col("_n").cast("string"))
    how = F.when(F.col("_d").isNotNull(), "domain").when(F.col("_n").isNotNull(), "name").when(F.coalesce("name_key", "domain").isNotNull(), "new")
    return out.select("mention_id", F.coalesce(found, fresh).alias("company_id"), how.alias("matched_by"))


def fold_company_links(links: DataFrame) -> DataFrame:
    """(founder_id, company_id, role, linked_at) -> one link per pair, with the first role that is known."""
    known = F.col("role").isNotNull() & (F.col("role") != "")
    return links.groupBy("founder_id", "company_id").agg(F.min_by("role", F.when(known, F.struct("linked_at", "role"))).alias("role"), F.min("linked_at").alias("linked_at"))


def linked_companies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Founder-company links after new ones: a pair is linked once, and a role is filled in only where there was none."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    known = F.col("role").isNotNull() & (F.col("role") != "")
    return both.groupBy("founder_id", "company_id").agg(F.min_by("role", F.when(known, F.struct("_new", "linked_at", "role"))).alias("role"), F.min("linked_at").alias("linked_at"))


def fold_aliases(aliases: DataFrame, mapping: DataFrame, names: DataFrame) -> DataFrame:
    """(founder_id, alias, normalized_name) of merged people under their canonical ids, once per name, with the duplicates'
    own names (`names`: id, display_name) added."""
    from ..functions import keys as K

    gone = names.join(mapping.filter("id <> canonical"), "id").select(F.col("canonical").alias("founder_id"), F.col("display_name").alias("alias"), K.person_name(F.col("display_name")).alias("normalized_name"))
    rows = rekeyed(aliases, mapping).unionByName(gone).filter("normalized_name <> ''")
    return rows.groupBy("founder_id", "normalized_name").agg(F.min("alias").alias("alias"))


def fold_axes(axes: DataFrame, deals: DataFrame) -> DataFrame:
    """(opportunity_id, axis, score, verdict) of folded deals (opportunity_id, survivor, created_at) on the surviving deal:
    its own rows stay, and axes it lacks come across from the earliest deal that has them."""
    at = F.struct(F.when(F.col("opportunity_id") == F.col("survivor"), 0).otherwise(1), "created_at", "opportunity_id")
    rows = axes.join(deals, "opportunity_id").groupBy("survivor", "axis").agg(F.min_by(F.struct("score", "verdict"), at).alias("a"))
    return rows.select(F.col("survivor").alias("opportunity_id"), "axis", "a.score", "a.verdict")


def enriched_companies(known: DataFrame, mentions: DataFrame) -> DataFrame:
    """(company_id, name_key, domain, website, sector, geo, description) filled from resolved mentions (company_id, mention_id
    and the same fields): only what is empty, from the earliest mention that has it."""
    fields = ["name_key", "domain", "website", "sector", "geo", "description"]
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    new = mentions.groupBy("company_id").agg(*(F.min_by(c, F.when(some(c), F.col("mention_id"))).alias(f"_{c}") for c in fields))
    out = known.join(new, "company_id", "left")
    return out.select("company_id", *(F.coalesce(F.nullif(c, F.lit("")), f"_{c}").alias(c) for c in fields))


def deduplicated_companies(companies: DataFrame, opportunities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies once per name key, with deals and founder links on the survivor: (companies, opportunities, links).

    `companies`: company_id, name, created_at; `opportunities`: opportunity_id, company_id, company_name; `links`: founder_id,
    company_id, role, linked_at. A named deal without a company takes the one of its name, a new one where there is none."""
    from ..functions import keys as K

    keyed = companies.withColumn("name_key", K.company_key(F.col("name")))
    used = opportunities.filter("company_id is not null").select("company_id").distinct().withColumn("_used", F.lit(True))
    ranked = survivor_by_name(keyed.join(used, "company_id", "left").select("company_id", "name_key", F.coalesce("_used", F.lit(False)).alias("has_deal"), "created_at"))
    kept = keyed.join(ranked.filter("company_id = survivor").select("company_id"), "company_id", "left_semi")
    mapping = ranked.select(F.col("company_id").alias("id"), F.col("survivor").alias("canonical"))
    deals = rekeyed(opportunities, mapping, "company_id")
    loose = deals.filter("company_id is null and trim(coalesce(company_name, '')) <> ''").select("opportunity_id", K.company_key(F.col("company_name")).alias("name_key"))
    found = resolved_companies(loose.select(F.col("opportunity_id").alias("mention_id"), "name_key", F.lit(None).cast("string").alias("domain")), kept.select("company_id", "name_key", F.lit(None).cast("string").alias("domain")))
    deals = deals.join(found.select(F.col("mention_id").alias("opportunity_id"), F.col("company_id").alias("_found")), "opportunity_id", "left").withColumn("company_id", F.coalesce(F.col("company_id").cast("string"), "_found")).drop("_found")
    return kept, deals, fold_company_links(rekeyed(links, mapping, "company_id"))
