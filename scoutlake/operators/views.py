"""Read views: feeds, lists with facets and pages, details with nested children, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .ranks import ranked


def contains_any(needle: str, *fields: str) -> Column:
    """Case-insensitive containment in any of the fields; an empty needle matches all."""
    q = needle.strip().lower()
    out = F.lit(q == "")
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(q))
    return out


def feed(signals: DataFrame, kind: str | None = None, needle: str = "", limit: int = 50) -> DataFrame:
    """The newest signals of a type that mention the needle; a top-k, so tasks keep `limit` rows each."""
    rows = signals.filter(contains_any(needle, "source", "signal_type", "external_id", "raw"))
    if kind is not None:
        rows = rows.filter(F.col("signal_type") == kind)
    return rows.orderBy(F.desc("ingested_at"), "signal_id").limit(limit)


def founder_list(founders: DataFrame, attributions: DataFrame) -> DataFrame:
    """Founders with their number of signals, 0 for none: one aggregate and one join instead of a count per founder."""
    counts = attributions.groupBy("founder_id").agg(F.count("*").alias("signal_count"), F.min(F.coalesce("occurred_at", "ingested_at")).alias("first_signal_at"))
    return founders.join(counts, "founder_id", "left").withColumn("signal_count", F.coalesce("signal_count", F.lit(0)))


def filtered_founders(founders: DataFrame, status: str | None = None, city: str | None = None, needle: str = "") -> DataFrame:
    rows = founders.filter(contains_any(needle, "display_name", "occupation", "city"))
    for column, value in (("status", status), ("city", city)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def sorted_page(rows: DataFrame, key: str, descending: bool, page: int, size: int = 10, tie: str = "founder_id") -> DataFrame:
    """One page by a key, nulls last in both directions, ties by id. A page number beyond the last means the last."""
    total = rows.count()
    last = max(0, -(-total // size) - 1)
    at = min(max(0, page), last)
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    return rows.orderBy(order, F.asc(tie)).offset(at * size).limit(size)


def facet_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n): the values of several facet columns, nulls aside, with their counts, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return rows.select(pairs).select("p.facet", "p.value").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def stalest(founders: DataFrame, n: int) -> DataFrame:
    return founders.orderBy(F.asc_nulls_first("last_checked_at"), "founder_id").limit(n)


def highlights(claims: DataFrame, per_founder: int = 6) -> DataFrame:
    """Each founder's claims of highest trust as one line of text."""
    w = Window.partitionBy("founder_id").orderBy(F.desc_nulls_last("trust"), "claim_id")
    top = claims.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_founder)
    return top.groupBy("founder_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "label"))), lambda x: x["label"]), "; ").alias("highlights"), F.count("*").alias("n_highlights"))


def founder_detail(founders: DataFrame, signals: DataFrame, claims: DataFrame) -> DataFrame:
    """Founders with the true numbers of their signals and claims, the latest signal and the best claim; the children
    themselves are `founder_children`."""
    s = signals.groupBy("founder_id").agg(F.count("*").alias("n_signals"), F.max_by("signal_id", F.struct("ingested_at", -F.col("signal_id"))).alias("latest_signal"))
    best = F.max_by(F.struct("claim_id", "trust"), F.struct("trust", -F.col("claim_id"))).alias("_best")
    c = claims.groupBy("founder_id").agg(F.count("*").alias("n_claims"), best).select("founder_id", "n_claims", F.col("_best.claim_id").alias("best_claim"), F.col("_best.trust").alias("best_trust"))
    return founders.join(s, "founder_id", "left").join(c, "founder_id", "left").fillna(0, ["n_signals", "n_claims"])


def founder_children(founders: DataFrame, signals: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All signals, latest first, and all claims, best first, of the founders, as rows in order within each founder. A
    sort by ranges: a founder with many rows spreads over tasks."""
    ids = founders.select("founder_id")
    s = signals.join(ids, "founder_id", "left_semi").select("founder_id", "ingested_at", "signal_id", "source")
    c = claims.join(ids, "founder_id", "left_semi").select("founder_id", "trust", "claim_id", "status")
    return s.orderBy("founder_id", F.desc("ingested_at"), "signal_id"), c.orderBy("founder_id", F.desc_nulls_last("trust"), "claim_id")


def opportunity_list(opportunities: DataFrame, founders: DataFrame, attributions: DataFrame) -> DataFrame:
    """Deals with their founder's name and the seconds from the founder's first signal to the decision (null before it)."""
    first = attributions.groupBy("founder_id").agg(F.min(F.coalesce("occurred_at", "ingested_at")).alias("first_signal_at"))
    rows = opportunities.join(founders.select("founder_id", "display_name"), "founder_id", "left").join(first, "founder_id", "left")
    return rows.withColumn("latency_seconds", F.unix_seconds("decided_at") - F.unix_seconds("first_signal_at"))


def indexed_blocks(rows: DataFrame, key: str, order: list[str], text: Column, most: int | None = None) -> DataFrame:
    """Each group's rows as one text block, numbered from 0 as citations count them; `most` keeps the first ones."""
    numbered = ranked(rows, [key], order, "_pos").withColumn("_pos", F.col("_pos") - 1).withColumn("_line", F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("] "), text))
    if most is not None:
        numbered = numbered.filter(F.col("_pos") < most)
    return numbered.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda x: x["_line"]), "\n").alias("block"), F.count("*").alias("n_lines"))


def chunked(rows: DataFrame, key: str, order: list[str], size: int = 12) -> DataFrame:
    """Rows of each key with the number of the chunk they fall into; a key may hold any share of the rows."""
    return ranked(rows, [key], order, "_at").select(*rows.columns, F.floor((F.col("_at") - 1) / size).cast("int").alias("chunk"))


def text_chunks(rows: DataFrame, key: str, order: list[str], line: Column, size: int = 12, between: str = "\n") -> DataFrame:
    """(key, chunk, block, n_lines): each key's lines in order as texts of `size` lines, numbered from 0. No text grows with its
    key, and a key's chunks are made in as many tasks as its rows ask for."""
    numbered = chunked(rows.withColumn("_line", line), key, order, size)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"])
    return numbered.groupBy(key, "chunk").agg(F.array_join(lines, between).alias("block"), F.count("*").alias("n_lines"))


def without_null_lists(rows: DataFrame) -> DataFrame:
    """Rows in which every column of arrays that is null is an empty one instead."""
    lists = {f.name: f.dataType for f in rows.schema.fields if isinstance(f.dataType, ArrayType)}
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in lists.items()})


def facets(rows: DataFrame, column: str) -> DataFrame:
    """The values a column takes, nulls aside, with the numbers of their rows: what a filter offers."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def unseen(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of the later snapshot that the earlier one lacks."""
    return now.join(before.select(key), key, "left_anti")


def founder_pages(founders: DataFrame, identities: DataFrame, signals: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """All that a founder's page shows, as ordered rows (founder_id, part, position, label, value, at): the identity (the
    first row of a founder), signals in the order in which they happened (undated last) with the confidence and method of
    their attribution, claims by trust (unknown last) with the numbers of their evidence, and the score history.

    Rows rather than one nested value, numbered by ranges: no founder is too large for a task. `position` counts from 1 within founder and part."""
    none = F.lit(None).cast("double")
    first = identities.groupBy("founder_id").agg(F.min_by(F.struct("identity_id", "github", "linkedin", "twitter", "website"), "identity_id").alias("i"))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("position"), F.concat_ws(":", F.lit(k), F.col(f"i.{k}")).alias("label"), F.col(f"i.{k}").alias("given")) for n, k in enumerate(("github", "twitter", "linkedin", "website"), 1)))).alias("k")
    own = first.select("founder_id", kinds).filter("k.given is not null").select("founder_id", F.lit("identity").alias("part"), "k.position", "k.label", none.alias("value"), F.lit(None).cast("timestamp").alias("at"))
    shown = edges.join(signals.select("signal_id", "source", "occurred_at"), "signal_id")
    timeline = ranked(shown, ["founder_id"], [F.asc_nulls_last("occurred_at"), "signal_id"]).select("founder_id", F.lit("signal").alias("part"), "position", F.concat_ws(":", F.col("signal_id").cast("string"), "source", "method").alias("label"), F.col("confidence").alias("value"), F.col("occurred_at").alias("at"))
    support = evidence.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(F.col("stance") == "supports").alias("for"), F.count_if(F.col("stance") == "refutes").alias("against"))
    rated = ranked(claims.join(support, "claim_id", "left"), ["founder_id"], [F.desc_nulls_last("trust"), "claim_id"])
    numbers = [F.coalesce(c, F.lit(0)).cast("string") for c in ("n", "for", "against")]
    believed = rated.select("founder_id", F.lit("claim").alias("part"), "position", F.concat_ws(":", F.col("claim_id").cast("string"), "status", *numbers).alias("label"), F.col("trust").alias("value"), "updated_at").withColumnRenamed("updated_at", "at")
    scores = ranked(history, ["founder_id"], ["created_at", "point_id"]).select("founder_id", F.lit("score").alias("part"), "position", F.lit("").alias("label"), F.col("score").alias("value"), F.col("created_at").alias("at"))
    return own.unionByName(timeline).unionByName(believed).unionByName(scores).join(founders.select("founder_id"), "founder_id", "left_semi")


def search_lines(founders: DataFrame, claims: DataFrame, per_founder: int = 15) -> DataFrame:
    """A line of text per founder for a search over all of them, with up to `per_founder` claims, the most trusted first: the
    feature that bounds a line."""
    w = Window.partitionBy("founder_id").orderBy(F.desc_nulls_last("trust"), "claim_id")
    top = claims.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_founder)
    said = top.groupBy("founder_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "statement"))), lambda x: x["statement"]), "; ").alias("_claims"))
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    line = F.concat(F.lit("["), F.col("founder_id").cast("string"), F.lit("] "), some("display_name", "None"), F.lit(" | "), some("occupation", "role?"), F.lit(" @ "), some("current_company", "no company"), F.lit(" | city="), some("city", "?"), F.lit(" | FounderScore="), F.coalesce(F.col("founder_score").cast("string"), F.lit("None")), F.lit(" | claims: "), some("_claims", "none"))
    return founders.join(said, "founder_id", "left").select("founder_id", line.alias("line"))


def search_matches(returned: DataFrame, founders: DataFrame) -> DataFrame:
    """(founder_id, relevance, reason) that a search returned, held against the founders there are, most relevant first."""
    return returned.join(founders.select("founder_id", "display_name", "founder_score", "city"), "founder_id").orderBy(F.desc("relevance"), "founder_id")


def thesis_lines(theses: DataFrame) -> DataFrame:
    """The default thesis as (field, value) rows; empty fields are left out."""
    fields = [c for c in theses.columns if c not in ("thesis_id", "is_default")]
    rows = theses.filter("is_default").orderBy("thesis_id").limit(1)
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("f")).select("f.*").filter("coalesce(value, '') <> ''")


def matching_deals(opportunities: DataFrame, needle: str) -> DataFrame:
    """Deals that mention the needle in any of the fields a list or an inbox shows."""
    return opportunities.filter(contains_any(needle, *(c for c in ("company_name", "idea", "sector", "geo", "status") if c in opportunities.columns)))


def subject_coverage(subjects: DataFrame, founders: DataFrame, claims: DataFrame, cold_below: int = 5, bull_at: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """A fixed set of subjects (founder_id) against what is known of them: one row each, and the set's properties as
    (property, holds): every subject known and with claims, one of them new, one of a high score, one contradicted.

    `founders`: founder_id, founder_score; `claims`: founder_id, status."""
    n = claims.groupBy("founder_id").agg(F.count("*").alias("n_claims"), F.bool_or(F.col("status") == "contradicted").alias("contradicted"))
    rows = subjects.select("founder_id").join(founders.select("founder_id", "founder_score", F.lit(True).alias("known")), "founder_id", "left").join(n, "founder_id", "left")
    rows = rows.select("founder_id", F.coalesce("known", F.lit(False)).alias("known"), "founder_score", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("contradicted", F.lit(False)).alias("contradicted"))
    cold = (F.col("n_claims") < cold_below) & (F.col("n_claims") > 0)
    holds = {"all_known": F.bool_and("known"), "all_have_claims": F.bool_and(F.col("n_claims") > 0), "has_cold_start": F.bool_or(cold), "has_bull": F.bool_or(F.coalesce(F.col("founder_score") >= bull_at, F.lit(False))), "has_contradiction": F.bool_or("contradicted")}
    wide = rows.agg(*(c.alias(k) for k, c in holds.items()))
    return rows, wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("property"), F.coalesce(k, F.lit(False)).alias("holds")) for k in holds))).alias("p")).select("p.*")
