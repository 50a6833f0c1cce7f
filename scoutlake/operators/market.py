"""Market research: citation positions, market signals, claims of four kinds, figures, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .ingest import first_of_each
from .ranks import ranked

#: Which goals' hits each extractor sees, in order, and the order of sizing metrics.
EXTRACTORS = {"sizing": ["sizing", "trend"], "competition": ["competition"], "comparables": ["comparables"], "kpi": ["kpi"]}
SIZING_ORDER = ["TAM", "SAM", "SOM", "CAGR"]
AXIS_ORDER = ["founder", "market", "idea"]


def extractor_hits(hits: DataFrame) -> DataFrame:
    """(opportunity_id, subgoal, pos, url) -> (opportunity_id, extractor, pos, url): each extractor's own numbering of the
    hits it saw, which its citations refer to."""
    views = [hits.filter(F.col("subgoal").isin(goals)).select("opportunity_id", F.lit(name).alias("extractor"), F.array_position(F.array(*map(F.lit, goals)), F.col("subgoal")).alias("_goal"), F.col("pos").alias("_pos"), "url") for name, goals in EXTRACTORS.items()]
    rows = views[0]
    for v in views[1:]:
        rows = rows.unionByName(v)
    numbered = ranked(rows, ["opportunity_id", "extractor"], ["_goal", "_pos"], "pos")
    return numbered.withColumn("pos", (F.col("pos") - 1).cast("int")).drop("_goal", "_pos")


def new_signals(hits: DataFrame, known: DataFrame) -> DataFrame:
    """One market signal per canonical URL that no signal has yet, the first hit's."""
    keyed = hits.withColumn("canonical_url", K.canonical_url(F.col("url"))).filter("canonical_url is not null and canonical_url <> ''")
    once = first_of_each(keyed, ["canonical_url"], ["opportunity_id", "subgoal", "pos"])
    return once.join(known.select("canonical_url"), "canonical_url", "left_anti").withColumn("kind", F.lit("market"))


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def statements(items: DataFrame) -> DataFrame:
    """Extracted items with the statement and key of the claim each makes; gaps, empty values and blank names make none.

    `items`: opportunity_id, extractor, item_no, metric, value, basis, name, positioning, round_size, stage, confidence,
    citations ARRAY<INT>, and any attributes. Sizing figures become market_size claims, benchmarks (kpi) market claims."""
    figure, name = F.col("extractor").isin("sizing", "kpi"), _filled("name")
    good = items.filter(F.when(figure, (F.coalesce("basis", F.lit("")) != "gap") & (F.coalesce("value", F.lit("")) != "")).otherwise(name != ""))
    rival = F.regexp_replace(F.concat(F.lit("Competitor: "), name, F.lit(" — "), F.coalesce("positioning", F.lit(""))), r"^[ —]+|[ —]+$", "")
    raised = F.concat(F.lit("Comparable: "), name, F.lit(" raised "), F.coalesce(F.nullif("round_size", F.lit("")), F.lit("undisclosed amount")), F.lit(" ("), F.coalesce(F.nullif("stage", F.lit("")), F.lit("stage n/a")), F.lit(")"))
    kind = F.col("extractor")
    statement = F.when(kind == "sizing", F.concat("metric", F.lit(": "), "value", F.lit(" ("), "basis", F.lit(")"))).when(kind == "kpi", F.concat("metric", F.lit(" benchmark: "), "value")).when(kind == "competition", rival).otherwise(raised)
    category = F.when(kind == "sizing", "market_size").when(kind == "kpi", "market").when(kind == "competition", "competition").otherwise("comparable")
    prefix = F.when(kind == "sizing", "market_size:").when(kind == "kpi", "kpi:").when(kind == "competition", "competitor:").otherwise("comparable:")
    key = F.concat(prefix, F.lower(F.when(figure, F.col("metric")).otherwise(name)))
    relevance = F.when(kind == "competition", 0.8).otherwise(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.7)))
    return good.withColumn("category", category).withColumn("statement", statement).withColumn("dedup_key", key).withColumn("relevance", relevance)


def claims(items: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted items -> claims keyed by (opportunity_id, dedup_key) and their evidence edges by cited URL.

    The first item of a key that cites a hit there is makes the claim, later ones add evidence; the first citation of a URL
    gives the edge its relevance. Citations that point nowhere are dropped, claims without any go."""
    named = statements(items)
    at = named.select("opportunity_id", "extractor", "item_no", "category", "statement", "dedup_key", "relevance", F.posexplode("citations").alias("nth", "pos"))
    cited = at.join(extractor_hits(hits), ["opportunity_id", "extractor", "pos"]).withColumn("canonical_url", K.canonical_url(F.col("url"))).filter("coalesce(canonical_url, '') <> ''")
    first = F.struct("item_no", "nth")
    rows = cited.groupBy("opportunity_id", "dedup_key").agg(F.min_by(F.struct("category", "statement", "item_no"), first).alias("c"), F.count_distinct("canonical_url").alias("n_sources"))
    edges = cited.groupBy("opportunity_id", "dedup_key", "canonical_url").agg(F.min_by("relevance", first).alias("relevance"))
    return rows.select("opportunity_id", "dedup_key", "c.category", "c.statement", "c.item_no", "n_sources"), edges


def upserted_claims(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Market claims after a run: one per (opportunity_id, dedup_key), the new statement where there is one."""
    key = ["opportunity_id", "dedup_key"]
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming.select(existing.columns))


def gaps(items: DataFrame) -> DataFrame:
    """Per opportunity the metrics that were looked for in vain, sizing before benchmarks."""
    line = F.struct(F.when(F.col("extractor") == "sizing", 0).otherwise(1).alias("_kind"), "item_no", F.concat(F.coalesce("metric", F.lit("None")), F.lit(": not found / unverified")).alias("line"))
    found = items.filter(F.col("extractor").isin("sizing", "kpi") & (F.col("basis") == "gap"))
    return found.groupBy("opportunity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "; ").alias("gaps"), F.count("*").alias("n_gaps"))


def first_urls(evidence: DataFrame, signals: DataFrame) -> DataFrame:
    """(claim_id, signal_id) -> (claim_id, url): one URL per claim, of its earliest signal that has one."""
    rows = evidence.select("claim_id", "signal_id").join(signals.filter("url is not null").select("signal_id", "url", "created_at"), "signal_id")
    return rows.groupBy("claim_id").agg(F.min_by("url", F.struct("created_at", "signal_id")).alias("url"))


def figures(claims: DataFrame, urls: DataFrame) -> DataFrame:
    """Claims of figures (claim_id, opportunity_id, category, attributes as JSON, trust, status) with the fields of their
    attributes and a URL, ranked TAM, SAM, SOM, CAGR, others within a deal."""
    parsed = F.from_json("attributes", "metric string, value string, basis string, confidence double")
    rows = claims.filter(F.col("category").isin("market_size", "market")).withColumn("a", parsed).join(urls, "claim_id", "left")
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SIZING_ORDER)), F.upper(F.coalesce("a.metric", F.lit("")))), F.lit(0)), F.lit(10)).cast("int")
    return rows.select("opportunity_id", "claim_id", F.when(F.col("category") == "market", "kpi").otherwise("sizing").alias("section"), order.alias("rank"), "a.metric", "a.value", "a.basis", "a.confidence", "trust", "status", "url")


def figures_of_any_shape(claims: DataFrame, urls: DataFrame) -> DataFrame:
    """As `figures`, from attributes of any JSON shape: metric, value, basis and unit as text whatever their type, confidence
    as a number, and all other fields as a map from name to JSON. Attributes that are no JSON object have none of these;
    the claim stays. Of a repeated name none can be right: such text is no JSON here."""
    rows = claims.filter(F.col("category").isin("market_size", "market")).withColumn("_v", F.try_parse_json("attributes"))
    rows = rows.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT<"), F.col("_v"))).join(urls, "claim_id", "left")
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    known = ("metric", "value", "basis", "unit", "confidence")
    rest = F.map_filter(F.try_variant_get("_v", "$", "map<string, variant>"), lambda k, _: ~k.isin(*known))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SIZING_ORDER)), F.upper(F.coalesce(text("metric"), F.lit("")))), F.lit(0)), F.lit(10)).cast("int")
    section = F.when(F.col("category") == "market", "kpi").otherwise("sizing")
    fields = [text(n).alias(n) for n in known[:-1]]
    return rows.select("opportunity_id", "claim_id", section.alias("section"), order.alias("rank"), *fields, F.try_variant_get("_v", "$.confidence", "double").alias("confidence"), F.transform_values(rest, lambda _, v: F.to_json(v)).alias("more"), "trust", "status", "url")


def _named(category: str, prefix: str, until: str) -> Column:
    own = F.when(F.startswith("statement", F.lit(prefix)), F.substring("statement", F.lit(len(prefix) + 1), F.length("statement"))).otherwise(F.col("statement"))
    return F.when(F.col("category") == category, F.split_part(own, F.lit(until), F.lit(1)))


def analysis(claims: DataFrame) -> DataFrame:
    """Per opportunity its market claims by category: figures in the order of their metrics, names read back from the
    statements of the others."""
    metric = F.upper(F.regexp_extract("statement", r"^(.*?)(?: benchmark)?: ", 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SIZING_ORDER)), metric), F.lit(0)), F.lit(10))
    rows = claims.withColumn("_rank", F.when(F.col("category") == "market_size", rank).otherwise(F.lit(0)))
    rows = rows.withColumn("_text", F.coalesce(_named("competition", "Competitor: ", " — "), _named("comparable", "Comparable: ", " raised "), F.col("statement")))
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("_rank", "item_no", "_text")))), lambda x: x["_text"]), "; ")
    return rows.groupBy("opportunity_id").agg(pick("market_size").alias("sizing"), pick("market").alias("kpi"), pick("competition").alias("competitors"), pick("comparable").alias("comparables"), F.count("*").alias("n_claims"))


def researched(opportunities: DataFrame, axes: DataFrame) -> DataFrame:
    """The deals that have a market axis, with its verdict, score and trend."""
    market = axes.filter("axis = 'market'").select("opportunity_id", "verdict", "score", "trend")
    return opportunities.join(market, "opportunity_id")


def researchable(requests: DataFrame) -> DataFrame:
    """Requests for research with a subject: an idea or a sector."""
    return requests.filter((_filled("idea") != "") | (_filled("sector") != ""))


def axes_of(opportunities: DataFrame, axes: DataFrame) -> DataFrame:
    """Deals with their axes as one ordered line; axes are never averaged."""
    rank = F.array_position(F.array(*map(F.lit, AXIS_ORDER)), F.col("axis"))
    line = axes.withColumn("_rank", rank).groupBy("opportunity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "axis", "verdict"))), lambda x: F.concat_ws("=", x["axis"], x["verdict"])), ",").alias("axes"), F.count("*").alias("n_axes"))
    return opportunities.join(line, "opportunity_id", "left").withColumn("n_axes", F.coalesce("n_axes", F.lit(0)))
