"""Whole deliveries: found people with their evidence against everything known, in one pass of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import delivery as V
from . import ingest as I
from . import resolve as R
from .graph import large, saved
from .views import text_chunks

#: Fixed value: the one kind of handle that only one person may hold.
EXCLUSIVE = "orcid"


def fresh_id(mention: Column) -> Column:
    """The id of a founder that a mention makes: it depends on the mention alone, so that a rerun gives the same."""
    return F.concat(F.lit("new-"), F.substring(F.sha2(mention.cast("string"), 256), 1, 16))


def evidence_of(payloads: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, pos, canonical_url, content_hash, source, confidence, method) and (id, kind, raw) -> all payloads once per
    mention and URL, identity values that are pages rather than people among them; the identifying values; the counts of
    what was rejected, by kind and reason."""
    parsed = saved(references.withColumn("p", K.parse_identity(F.col("kind"), F.col("raw"))))  # read three times
    pages = parsed.filter("p.artifact_url is not null").select(
        "id", F.lit(1_000_000).alias("pos"), F.col("p.artifact_url").alias("canonical_url"), F.lit(None).cast("string").alias("content_hash"), F.col("kind").alias("source"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("method"), F.lit("profile_activity").alias("signal_type"), F.lit(0.55).alias("source_reliability"),
    )
    both = payloads.filter("canonical_url is not null and canonical_url <> ''").unionByName(pages, allowMissingColumns=True)
    once = I.first_of_each(both, ["id", "canonical_url"], ["pos", "source"])
    handles = parsed.filter("p.value is not null").select("id", "kind", F.col("p.value").alias("value")).distinct()
    rejected = parsed.filter("p.rejected is not null and p.rejected <> 'empty'").select("kind", F.col("p.rejected").alias("rejected"))
    return once, handles, V.reject_counts(rejected)


def claimed(handles: DataFrame, held: DataFrame) -> DataFrame:
    """Handles of the exclusive kind that another founder holds already, or an earlier mention of the same batch takes:
    (founder_id, kind, value) rows that must not be stored."""
    own = large(handles.filter(F.col("kind") == EXCLUSIVE).select("founder_id", "kind", F.lower("value").alias("value"), "mention_id"))
    before = held.filter(F.col("kind") == EXCLUSIVE).groupBy("kind", F.lower("value").alias("value")).agg(F.min("founder_id").alias("holder"))
    first = own.groupBy("kind", "value").agg(F.min_by("founder_id", "mention_id").alias("first"))
    rows = own.join(before, ["kind", "value"], "left").join(first, ["kind", "value"])
    return large(rows.filter(F.coalesce("holder", "first") != F.col("founder_id")).select("founder_id", "kind", "value").distinct())


def placed(people: DataFrame, decisions: DataFrame, handles: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each mention's founder. Merged and reviewed ones attach to the person they matched; new ones that identifying handles
    or artifacts make one person become one founder; one in conflict is kept apart, with its counterpart on record."""
    new = decisions.filter("decision = 'new'").select("id")
    joined = large(R.merges(people.join(new, "id", "left_semi"), handles.join(new, "id", "left_semi"), artifacts.join(new, "id", "left_semi")))
    rows = people.select("id").join(decisions, "id").join(joined, "id", "left")
    attach = F.col("decision").isin("merge", "review") & (F.col("method") != "conflict")
    founder = F.when(attach, F.col("matched_id").cast("string")).otherwise(fresh_id(F.coalesce("canonical", "id")))
    counterpart = F.when(F.col("method") == "conflict", F.col("matched_id").cast("string"))
    return rows.select("id", founder.alias("founder_id"), (~attach).alias("created"), (F.col("decision") == "review").alias("flagged"), "method", "confidence", counterpart.alias("counterpart_id"))


def new_reviews(people: DataFrame, handles: DataFrame, placed: DataFrame, known: DataFrame) -> DataFrame:
    """A review for each unresolved mention (uncertain or in conflict), once per fingerprint and not if it is known."""
    prints = R.review_fingerprint(people, handles).join(placed.filter("flagged"), "id")
    once = I.first_of_each(prints.select("fingerprint", "id", "founder_id", "counterpart_id", "method"), ["fingerprint"], ["id"])
    return once.join(large(known.select("fingerprint")), "fingerprint", "left_anti")


def delivered(mentions: DataFrame, payloads: DataFrame, references: DataFrame, founders: DataFrame, held: DataFrame, signals: DataFrame, edges: DataFrame, reviews: DataFrame, as_of: Column, placements: DataFrame | None = None) -> dict[str, DataFrame]:
    """A delivery against the stored tables; the frames to append or replace, by name.

    `mentions`: id, display_name, city, company, education, occupation, discovery_confidence; `payloads` and `references` as
    in `evidence_of`; `founders`: founder_id and the fields of a mention; `held`: founder_id, kind, value; `signals`:
    signal_id, canonical_url, content_hash, kind; `edges`: founder_id, signal_id, confidence, method, attributed_at;
    `reviews`: fingerprint; `placements`: key, founder_id of earlier deliveries, where each mention went. Founder ids are strings.

    Mentions that are no persons or come without evidence are refused and counted. Artifacts are met by URL, else by content,
    among stored ones and those that earlier mentions of the delivery (by id) bring; new ones are stored once. Delivering the
    same again finds every artifact, edge and review in place, and every mention where it was: one that was attached
    for review has shared its evidence since with others of its name, and its placement tells whose it is."""
    mentions, payloads, references, founders, held, signals, edges = map(large, (mentions, payloads, references, founders, held, signals, edges))
    once, handles, rejects = evidence_of(payloads, references)
    rows = mentions.withColumn("founder_id", F.col("id"))
    people, refused = V.gated(rows, once.select(F.col("id").alias("founder_id")))
    people = saved(people.drop("founder_id"))
    once = once.join(people.select("id"), "id", "left_semi")
    handles = saved(handles.join(people.select("id"), "id", "left_semi"))
    found = I.materialised(once, signals)
    # the first of a mention's payloads for each signal counts
    made = F.concat(F.lit("url-"), F.substring(F.sha2("signal_url", 256), 1, 24))
    found = saved(I.first_of_each(found.withColumn("signal_id", F.coalesce(F.col("signal_id").cast("string"), made)), ["id", "signal_id"], ["pos", "canonical_url"]))
    fresh = I.first_of_each(found.filter("matched_by = 'new'").select("signal_id", "canonical_url", "content_hash", "source", "id", "pos"), ["signal_id"], ["id", "pos"])
    promoted = found.filter("promoted").select("signal_id").distinct()
    artifacts = found.filter("signal_url is not null").select("id", F.col("signal_url").alias("url")).distinct()
    known = founders.withColumnRenamed("founder_id", "id")
    urls = edges.join(signals.select(F.col("signal_id"), F.col("canonical_url").alias("url")), "signal_id").select(F.col("founder_id").alias("id"), "url").filter("url is not null").distinct()
    keys = saved(R.mention_keys(people, handles, artifacts))
    holders = None if placements is None else keys.join(placements, "key").select(F.col("id").alias("i_id"), F.col("founder_id").alias("e_id"))
    decisions = saved(R.resolved(people, known, handles, held.withColumnRenamed("founder_id", "id"), artifacts, urls, holders))
    at = saved(placed(people, decisions, handles, artifacts))
    named = people.join(at, "id")
    made = I.first_of_each(named.filter("created").select("founder_id", "id", "display_name", "city", "company", "occupation", "education", "discovery_confidence"), ["founder_id"], ["id"])
    better = named.filter("not created").select("founder_id", F.col("id").alias("mention_id"), "discovery_confidence", "city", "occupation", F.col("company").alias("current_company"))
    enriched = V.enriched(founders.withColumnRenamed("company", "current_company"), better)
    own = handles.join(at.select("id", "founder_id"), "id").select("founder_id", "kind", "value", F.col("id").alias("mention_id"))
    withheld = claimed(own, held)
    stored = V.new_handles(held, own.join(withheld, (own["founder_id"] == withheld["founder_id"]) & (own["kind"] == withheld["kind"]) & (F.lower(own["value"]) == withheld["value"]), "left_anti"))
    links = found.join(at.select("id", "founder_id"), "id").select("founder_id", "signal_id", "confidence", "method", as_of.alias("attributed_at"))
    attributed = I.attributed(edges.withColumn("signal_id", F.col("signal_id").cast("string")), links)
    trace = V.trace_rows(links, "sourcing")
    return {
        "placed": at, "founders": made, "enriched": enriched, "handles": stored, "withheld": withheld, "signals": fresh, "promoted": promoted, "edges": attributed, "trace": trace, "found": found,
        "placements": keys.join(at.select("id", "founder_id"), "id").groupBy("key").agg(F.min("founder_id").alias("founder_id")),
        "reviews": new_reviews(people, handles, at, reviews), "refused": refused, "rejects": rejects,
    }


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """(metric, n): what a delivery did."""
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    at = results["placed"]
    rows = count("new_founders", results["founders"]).unionByName(count("resolved_to_existing", at.filter("not created"))).unionByName(count("new_signals", results["signals"])).unionByName(count("new_handles", results["handles"])).unionByName(count("withheld", results["withheld"])).unionByName(count("reviews", results["reviews"]))
    refused = results["refused"].select(F.concat(F.lit("dropped_"), "reason").alias("metric"), "n")
    return rows.unionByName(refused).unionByName(results["rejects"].select(F.concat_ws(":", F.lit("identity"), "kind", "reason").alias("metric"), "n"))


def opened_deals(requests: DataFrame, founders: DataFrame, edges: DataFrame, companies: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(request_id, founder_id, company_name, idea, sector, geo) -> (deals, refused requests): a deal of a known founder, about
    an idea or a sector, with the company of its name and a clock that starts at the founder's first signal, else now.

    `edges`: founder_id, occurred_at, ingested_at; `companies`: company_id, name_key, domain."""
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    rows = requests.select("request_id", "founder_id", text("company_name").alias("company_name"), text("idea").alias("idea"), text("sector").alias("sector"), "geo")
    rows = rows.join(founders.select("founder_id").distinct().withColumn("_known", F.lit(True)), "founder_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_founder").when(F.col("idea").isNull() & F.col("sector").isNull(), "no_subject")
    rows = rows.withColumn("reason", reason).drop("_known")
    from .merge import resolved_companies

    good = rows.filter("reason is null").drop("reason")
    asked = good.filter("company_name is not null").select(F.col("request_id").alias("mention_id"), K.company_key(F.col("company_name")).alias("name_key"), F.lit(None).cast("string").alias("domain"))
    found = resolved_companies(asked, companies).select(F.col("mention_id").alias("request_id"), "company_id")
    first = edges.groupBy("founder_id").agg(F.min(F.coalesce("occurred_at", "ingested_at")).alias("first_signal_at"))
    deals = good.join(found, "request_id", "left").join(first, "founder_id", "left").withColumn("first_signal_at", F.coalesce("first_signal_at", as_of)).withColumn("status", F.lit("screening"))
    return deals, rows.filter("reason is not null").select("request_id", "founder_id", "reason")


#: How far deck pages are trusted, and how relevant what they assert is taken to be.
DECK_RELIABILITY, DECK_RELEVANCE = 0.4, 0.85


def deck_claims(extracted: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deck_id, claim_no, category, statement, source_page) and (deck_id, page, signal_id) -> (claims with trust and status,
    numbers minted and dropped per deck). A claim needs a statement and a page that exists."""
    from ..functions import scoring as S

    at = pages.groupBy("deck_id", F.col("page").alias("source_page")).agg(F.min("signal_id").alias("signal_id"))
    rows = extracted.join(at, ["deck_id", "source_page"], "left").withColumn("_good", F.col("signal_id").isNotNull() & (F.trim(F.coalesce("statement", F.lit(""))) != ""))
    weight = S.evidence_weight(F.lit(DECK_RELIABILITY), F.lit(1.0), F.lit(DECK_RELEVANCE))
    trust = S.rounded(weight, 4)
    claims = rows.filter("_good").select("deck_id", "claim_no", "category", "statement", "signal_id", F.concat(F.lit("deck p."), F.col("source_page").cast("string")).alias("source_pointer"), F.round(weight, 4).alias("weight"), trust.alias("trust"), S.status(trust, F.lit(None).cast("double")).alias("status"))
    counts = rows.groupBy("deck_id").agg(F.count_if("_good").alias("minted"), F.count_if(~F.col("_good")).alias("dropped"))
    return claims, counts


def inbound(decks: DataFrame, pages: DataFrame, extracted_founders: DataFrame, extracted: DataFrame, founders: DataFrame, held: DataFrame, companies: DataFrame, industries: Column, as_of: Column) -> dict[str, DataFrame]:
    """Applications by deck: (deck_id, company_name, idea, sector, geo), their pages (deck_id, company, page, text), the
    founders a reader found in each (deck_id, pos, name, role, linkedin) and the claims.

    A deck without a company name, readable page or founder is refused. The first founder is resolved against those
    known, the company by name; the pages become signals of the founder; claims cite pages; the thesis rejects a sector."""
    from ..sources.readers import deck_pages
    from .merge import resolved_companies
    from .screening import thesis_rejects

    signals = deck_pages(pages).withColumn("deck_id", F.substring_index("external_id", "#", 1)).withColumn("page", F.substring_index("external_id", "#", -1).cast("int"))
    signals = signals.withColumn("signal_id", F.concat_ws(":", F.lit("deck"), "external_id"))
    primary = I.first_of_each(extracted_founders.filter("trim(coalesce(name, '')) <> ''"), ["deck_id"], ["pos"])
    rows = decks.withColumn("deck_id", F.col("deck_id").cast("string")).withColumn("company_name", F.trim(F.coalesce("company_name", F.lit(""))))
    primary = primary.withColumn("deck_id", F.col("deck_id").cast("string"))
    readable = signals.select("deck_id").distinct().withColumn("_pages", F.lit(True))
    rows = rows.join(readable, "deck_id", "left").join(primary.select("deck_id", "name", "role", "linkedin"), "deck_id", "left")
    rows = rows.withColumn("refused", F.when(F.col("company_name") == "", "no_company").when(F.col("_pages").isNull(), "no_text").when(F.col("name").isNull(), "no_founder"))
    good = saved(rows.filter("refused is null").drop("refused", "_pages"))
    people = good.select(F.col("deck_id").alias("id"), F.col("name").alias("display_name"), F.lit(None).cast("string").alias("city"), F.col("company_name").alias("company"), F.array().cast("array<string>").alias("education"))
    people = saved(people)
    handles = good.select(F.col("deck_id").alias("id"), F.lit("linkedin").alias("kind"), K.parse_identity(F.lit("linkedin"), F.col("linkedin"))["value"].alias("value")).filter("value is not null")
    decisions = saved(R.resolved(people, founders.withColumnRenamed("founder_id", "id"), handles, held.withColumnRenamed("founder_id", "id")))
    at = saved(placed(people, decisions, handles, handles.select("id", F.col("value").alias("url")).limit(0)))
    company = resolved_companies(good.select(F.col("deck_id").alias("mention_id"), K.company_key(F.col("company_name")).alias("name_key"), F.lit(None).cast("string").alias("domain")), companies)
    claims, counts = deck_claims(extracted.withColumn("deck_id", F.col("deck_id").cast("string")).join(good.select("deck_id"), "deck_id", "left_semi"), signals.select("deck_id", "page", "signal_id"))
    deals = good.join(at.select(F.col("id").alias("deck_id"), "founder_id", "created"), "deck_id").join(company.select(F.col("mention_id").alias("deck_id"), "company_id"), "deck_id").join(counts, "deck_id", "left")
    rejected = thesis_rejects(F.col("sector"), industries)
    deals = deals.select("deck_id", "founder_id", "created", "company_id", "company_name", "idea", "sector", "geo", F.when(rejected, "rejected").otherwise("screening").alias("status"), as_of.alias("first_signal_at"), F.coalesce("minted", F.lit(0)).alias("claims_minted"), F.coalesce("dropped", F.lit(0)).alias("claims_dropped"))
    pages_of = signals.join(deals.select("deck_id", "founder_id"), "deck_id")
    edges = pages_of.select("founder_id", "signal_id", F.lit(0.7).alias("confidence"), F.lit("deck_primary_founder").alias("method"), as_of.alias("attributed_at"))
    links = deals.select("founder_id", "company_id", F.lit("founder").alias("role"))
    return {"deals": deals, "signals": pages_of, "edges": edges, "companies": links, "claims": claims, "refused": rows.filter("refused is not null").select("deck_id", "refused")}


def page_blocks(pages: DataFrame) -> DataFrame:
    """(deck_id, page, text) -> one text block per deck for a reader: its pages in order under their numbers, blank ones
    left out."""
    some = F.coalesce("text", F.lit("")) != ""
    line = F.when(some, F.struct("page", F.concat(F.lit("[deck p."), F.col("page").cast("string"), F.lit("]\n"), "text").alias("line")))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n")
    return pages.groupBy("deck_id").agg(F.when(F.count_if(some) > 0, block).otherwise("(no deck text)").alias("block"), F.count_if(some).alias("n_pages"))


def page_chunks(pages: DataFrame, size: int = 12) -> DataFrame:
    """What `page_blocks` says in texts of `size` pages, (deck_id, chunk, block, n_pages): for decks of any length. Decks
    without text have none."""
    line = F.concat(F.lit("[deck p."), F.col("page").cast("string"), F.lit("]\n"), "text")
    out = text_chunks(pages.filter("coalesce(text, '') <> ''"), "deck_id", ["page", "text"], line, size, "\n\n")
    return out.withColumnRenamed("n_lines", "n_pages")


def unmet(candidates: DataFrame, known: DataFrame, most: int = 35) -> DataFrame:
    """(name, pos) candidates whose folded name no known person has, the first of each name, at most `most` of a run: the
    feature that bounds what is looked into."""
    rows = candidates.withColumn("_name", K.comparison_text(F.col("name"))).filter("_name <> ''")
    once = I.first_of_each(rows, ["_name"], ["pos"])
    return once.join(known.select(K.comparison_text(F.col("display_name")).alias("_name")).distinct(), "_name", "left_anti").drop("_name").orderBy("pos").limit(most)
