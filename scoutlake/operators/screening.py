"""Screening: founder axis, trends, idea axis, thesis filter, decisions, memo anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .views import text_chunks

# Bands and limits of the axes.
BULL_AT, BEAR_BELOW, COLD_START, CONFIDENCE_CAP, CONFIDENCE_SCALE, DEADBAND = 40.0, 15.0, 6, 0.95, 5.0, 1.0
VERDICTS = {"survives_as_is": "bull", "pivot_needed": "neutral", "fails": "bear"}
DECISION_STATUS = {"pursue": "decided", "track": "diligence", "pass": "rejected"}
AXES = ["founder", "market", "idea"]


def last_step(points: DataFrame) -> DataFrame:
    """(founder_id, score, created_at, point_id) -> number of points and the last difference of each founder."""
    w = Window.partitionBy("founder_id").orderBy("created_at", "point_id")
    rows = points.withColumn("_step", F.col("score") - F.lag("score").over(w))
    return rows.groupBy("founder_id").agg(F.count("*").alias("n_points"), F.max_by("_step", F.struct("created_at", "point_id")).alias("step"))


def founder_axis(scores: DataFrame, claims: DataFrame, points: DataFrame) -> DataFrame:
    """(founder_id, founder_score), claims with trust, score points -> score, verdict, trend, confidence and gaps.

    Few claims lower the confidence and never the verdict; a founder without score or claims is neutral."""
    mass = claims.groupBy("founder_id").agg(F.count("*").alias("n_claims"), F.sum(F.coalesce("trust", F.lit(0.0))).alias("_mass"))
    rows = scores.join(mass, "founder_id", "left").join(last_step(points), "founder_id", "left")
    n, points_n = F.coalesce("n_claims", F.lit(0)), F.coalesce("n_points", F.lit(0))
    cold = n < COLD_START
    verdict = F.when(F.col("founder_score") >= BULL_AT, "bull").when((F.col("founder_score") < BEAR_BELOW) & ~cold, "bear").otherwise("neutral")
    trend = F.when(points_n < 2, "stable").when(F.col("step") >= DEADBAND, "improving").when(F.col("step") <= -DEADBAND, "declining").otherwise("stable")
    confidence = F.round(F.least(F.lit(CONFIDENCE_CAP), 1 - F.exp(-F.coalesce("_mass", F.lit(0.0)) / CONFIDENCE_SCALE)), 2)
    gaps = F.array_compact(F.array(F.when(F.col("founder_score").isNull(), "no score"), F.when(cold & (n > 0), "cold start"), F.when(points_n < 2, "no history")))
    return rows.select("founder_id", F.col("founder_score").alias("score"), verdict.alias("verdict"), trend.alias("trend"), confidence.alias("confidence"), F.array_join(gaps, "; ").alias("gaps"))


def upserted_founder_axes(deals: DataFrame, existing: DataFrame, scores: DataFrame, claims: DataFrame, points: DataFrame, cites: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The founder axis of each deal (opportunity_id, founder_id) computed and put in place of the one it had, and the
    evidence it rests on.

    `existing`: opportunity_id, axis, score, verdict, trend, confidence, gaps; axes of other kinds, and of deals that are not
    among `deals`, stay as they are. The trend is of the founder's score history, not against the axis before. Evidence is
    a row (opportunity_id, claim_id, trust, url) for each different page that supports a claim; a claim without one has a row
    without a URL. `claims`: founder_id, claim_id, trust; `cites`: claim_id, signal_id, stance; `signals`: signal_id, url.
    A deal of a founder whom `scores` lacks gets a neutral axis without score."""
    people = deals.select("founder_id").distinct()
    mine = people.join(scores.select("founder_id", "founder_score"), "founder_id", "left")
    own = claims.join(people, "founder_id", "left_semi")
    axis = founder_axis(mine, own, points.join(people, "founder_id", "left_semi"))
    new = deals.select("opportunity_id", "founder_id").join(axis, "founder_id").select("opportunity_id", F.lit("founder").alias("axis"), "score", "verdict", "trend", "confidence", "gaps")
    replaced = new.select("opportunity_id", "axis")
    rows = existing.join(replaced, ["opportunity_id", "axis"], "left_anti").select(new.columns).unionByName(new)
    pages = cites.filter("stance = 'supports'").join(signals.filter("url is not null").select("signal_id", "url"), "signal_id").select("claim_id", "url").distinct()
    evidence = deals.select("opportunity_id", "founder_id").join(own.select("founder_id", "claim_id", "trust"), "founder_id").join(pages, "claim_id", "left").select("opportunity_id", "claim_id", "trust", "url")
    return rows, evidence


def trend(previous: Column, now: Column) -> Column:
    """The axes' trend: strictly beyond the deadband, stable without a previous score."""
    return F.when(previous.isNull() | now.isNull(), "stable").when(now - previous > DEADBAND, "improving").when(previous - now > DEADBAND, "declining").otherwise("stable")


def upserted_axes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Axis rows (opportunity_id, axis, score, ...) after an update, one per key, with the trend against the old score."""
    old = existing.select("opportunity_id", "axis", F.col("score").alias("_before"))
    new = incoming.join(old, ["opportunity_id", "axis"], "left").withColumn("trend", trend(F.col("_before"), F.col("score"))).drop("_before")
    kept = existing.join(incoming.select("opportunity_id", "axis"), ["opportunity_id", "axis"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def anchored(judgements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(opportunity_id, verdict, confidence, cited ARRAY, n_claims) with citations that exist only, the confidence capped
    on thin evidence and the verdict's band."""
    cited = judgements.select("opportunity_id", F.posexplode_outer("cited").alias("pos", "claim_id"))
    real = cited.join(evidence.select("opportunity_id", "claim_id").distinct().withColumn("_real", F.lit(True)), ["opportunity_id", "claim_id"], "left")
    per = real.groupBy("opportunity_id").agg(F.count_if(F.col("_real")).alias("n_resolved"), F.count_if(F.col("claim_id").isNotNull() & F.col("_real").isNull()).alias("n_dropped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_real"), F.struct("pos", "claim_id")))), lambda x: x["claim_id"].cast("string")), ",").alias("claim_ids"))
    verdicts = F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv))
    confidence = F.round(F.when(F.col("n_claims") < COLD_START, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")), 2)
    return judgements.join(per, "opportunity_id").select("opportunity_id", F.element_at(verdicts, F.col("verdict")).alias("verdict"), confidence.alias("confidence"), "claim_ids", "n_resolved", "n_dropped")


def thesis_rejects(sector: Column, industries: Column) -> Column:
    """Whether a sector matches none of the thesis's industries, either containing the other; no sector or thesis passes."""
    low = F.lower(sector)
    return F.coalesce((F.size(industries) > 0) & (low != "") & ~F.exists(industries, lambda a: F.contains(F.lower(a), low) | F.contains(low, F.lower(a))), F.lit(False))


def decided(opportunities: DataFrame, decisions: DataFrame, axes: DataFrame) -> DataFrame:
    """Deals after decisions: the status they mean and when; a pursuit without any axis is refused."""
    screened = axes.select("opportunity_id").distinct().withColumn("_axes", F.lit(True))
    status = F.create_map(*(F.lit(x) for kv in DECISION_STATUS.items() for x in kv))
    rows = opportunities.join(decisions.select("opportunity_id", "decision", F.col("decided_at").alias("_at")), "opportunity_id", "left").join(screened, "opportunity_id", "left")
    valid = F.coalesce(F.map_contains_key(status, F.col("decision")) & ((F.col("decision") != "pursue") | F.col("_axes")), F.lit(False))
    return rows.withColumn("refused", F.col("decision").isNotNull() & ~valid).withColumn("status", F.when(valid, F.element_at(status, F.coalesce("decision", F.lit("")))).otherwise(F.col("status"))).withColumn("decided_at", F.when(valid, F.col("_at")).otherwise(F.col("decided_at"))).drop("_at", "_axes")


def without_ids(text: Column) -> Column:
    """Prose without bracketed claim ids (UUIDs), spacing healed."""
    uuid = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    out = F.regexp_replace(text, rf"\s*[\[(]\s*{uuid}(?:\s*[,;]\s*{uuid})*\s*[\])]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([.,;:!?])", "$1"), r" {2,}", " "))


def memo_anchors(sections: DataFrame, evidence: DataFrame, required: list[str]) -> DataFrame:
    """(memo_id, section, cited ARRAY) -> per memo: sections kept, citations resolved and dropped, required ones missing."""
    cited = sections.select("memo_id", "section", F.explode_outer("cited").alias("claim_id")).join(evidence.select("claim_id").distinct().withColumn("_real", F.lit(True)), "claim_id", "left")
    per = cited.groupBy("memo_id", "section").agg(F.count_if(F.col("_real")).alias("good"), F.count_if(F.col("claim_id").isNotNull() & F.col("_real").isNull()).alias("bad"))
    names = F.array(*map(F.lit, required))
    return per.groupBy("memo_id").agg(F.count_if(F.col("good") > 0).alias("anchored_sections"), F.sum("good").alias("citations"), F.sum("bad").alias("dropped"), F.array_join(F.array_except(names, F.collect_set(F.when(F.col("good") > 0, F.col("section")))), ",").alias("missing"))


def evidence_for_idea(opportunities: DataFrame, claims: DataFrame, axes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the idea axis is judged on: claims of the deal's founder and of the deal itself as (opportunity_id, side, claim_id,
    statement, category, trust), and per deal with an idea or a sector the counts and the market axis in one line.

    `claims`: claim_id, founder_id, opportunity_id, statement, category, trust; `axes`: opportunity_id, axis, verdict, score,
    rationale."""
    deals = opportunities.filter("trim(coalesce(idea, '')) <> '' or trim(coalesce(sector, '')) <> ''")
    fields = ["claim_id", "statement", "category", "trust"]
    own = deals.select("opportunity_id", "founder_id").join(claims.filter("founder_id is not null").select("founder_id", *fields), "founder_id").select("opportunity_id", F.lit("founder").alias("side"), *fields)
    market = deals.select("opportunity_id").join(claims.filter("opportunity_id is not null").select("opportunity_id", *fields), "opportunity_id").select("opportunity_id", F.lit("market").alias("side"), *fields)
    rows = own.unionByName(market)
    counts = rows.groupBy("opportunity_id").agg(F.count_if(F.col("side") == "founder").alias("n_founder_claims"), F.count_if(F.col("side") == "market").alias("n_market_claims"))
    line = F.concat(F.lit("verdict="), "verdict", F.lit(", score="), F.col("score").cast("string"), F.lit(": "), F.coalesce("rationale", F.lit("")))
    summary = axes.filter("axis = 'market'").select("opportunity_id", line.alias("market_summary"))
    zero = {"n_founder_claims": 0, "n_market_claims": 0}
    return rows, deals.select("opportunity_id").join(counts, "opportunity_id", "left").fillna(zero).join(summary, "opportunity_id", "left")


def provenance(cited: DataFrame, evidence: DataFrame, signals: DataFrame, key: str, supports_only: bool = False) -> DataFrame:
    """(key, claim_id) -> per key the different URLs of the cited claims' evidence, sorted, as one line."""
    edges = evidence.filter("stance = 'supports'") if supports_only else evidence
    urls = cited.select(key, "claim_id").distinct().join(edges.select("claim_id", "signal_id"), "claim_id").join(signals.filter("url is not null").select("signal_id", "url"), "signal_id").select(key, "url").distinct()
    return urls.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("url")), " ").alias("urls"), F.count("*").alias("n_urls"))


def screened(opportunities: DataFrame, existing: DataFrame, founder_axis: DataFrame, market_axis: DataFrame, idea_axis: DataFrame, refresh_market: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deals after a screening: three axis rows each, side by side and never averaged, and the status `diligence`.

    `founder_axis` is per founder, the others per deal; a market axis that is there already is kept unless refreshed.
    Axis rows: opportunity_id, axis, score, verdict, confidence; trends compare with the rows before."""
    fields = ["score", "verdict", "confidence"]
    deals = opportunities.select("opportunity_id", "founder_id")
    own = deals.join(founder_axis.select("founder_id", *fields), "founder_id").select("opportunity_id", F.lit("founder").alias("axis"), *fields)
    market = market_axis.join(deals.select("opportunity_id"), "opportunity_id", "left_semi")
    if not refresh_market:
        market = market.join(existing.filter("axis = 'market'").select("opportunity_id"), "opportunity_id", "left_anti")
    idea = idea_axis.join(deals.select("opportunity_id"), "opportunity_id", "left_semi")
    new = own.unionByName(market.select("opportunity_id", F.lit("market").alias("axis"), *fields)).unionByName(idea.select("opportunity_id", F.lit("idea").alias("axis"), *fields))
    return upserted_axes(existing, new), opportunities.withColumn("status", F.lit("diligence"))


def _claim_line() -> Column:
    return F.concat(F.lit("["), F.col("claim_id").cast("string"), F.lit("] ("), "category", F.lit(", trust="), F.coalesce(F.col("trust").cast("string"), F.lit("None")), F.lit(") "), "statement")


def claim_blocks(claims: DataFrame, key: str, label: str) -> DataFrame:
    """(key, claim_id, category, trust, statement) -> one text block per key for a reader, a line a claim in the order of ids."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("claim_id", _claim_line().alias("line")))), lambda x: x["line"])
    return claims.groupBy(key).agg(F.concat(F.lit(f"## {label}\n"), F.array_join(lines, "\n")).alias("block"), F.count("*").alias("n_claims"))


def claim_chunks(claims: DataFrame, key: str, label: str, size: int = 12) -> DataFrame:
    """What `claim_blocks` says in texts of `size` claims, (key, chunk, block, n_claims): for keys of any size."""
    out = text_chunks(claims, key, ["claim_id"], _claim_line(), size)
    return out.select(key, "chunk", F.concat(F.lit(f"## {label}\n"), "block").alias("block"), F.col("n_lines").alias("n_claims"))


def memo_view(memos: DataFrame) -> DataFrame:
    """(opportunity_id, generated_at, memo_id, recommendation, confidence, gaps, sections) -> each deal's latest memo as it is
    shown; no gaps are an empty list."""
    at = F.struct("generated_at", "memo_id")
    fields = [c for c in ("recommendation", "confidence", "gaps", "generated_at", "sections") if c in memos.columns]
    last = memos.groupBy("opportunity_id").agg(F.max_by(F.struct("memo_id", *fields), at).alias("m"))
    out = last.select("opportunity_id", "m.*")
    return out.withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))


def memo_quality(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a memo's points (memo_id, part `hypothesis` or `traction`, point_no, text, cited ARRAY) rest on, per memo:
    hypotheses keep the citations that exist, a metric of traction without any goes, and what was dropped is a gap."""
    cited = points.select("memo_id", "part", "point_no", F.explode_outer("cited").alias("claim_id"))
    real = cited.join(evidence.select("claim_id").distinct().withColumn("_real", F.lit(True)), "claim_id", "left")
    per = real.groupBy("memo_id", "part", "point_no").agg(F.count_if("_real").alias("good"), F.count_if(F.col("claim_id").isNotNull() & F.col("_real").isNull()).alias("bad"))
    hypothesis, traction = F.col("part") == "hypothesis", F.col("part") == "traction"
    sums = per.groupBy("memo_id").agg(
        F.count_if(hypothesis).alias("n_hypotheses"), F.coalesce(F.sum(F.when(hypothesis, F.col("bad"))), F.lit(0)).alias("_dropped"), F.count_if(traction & (F.col("good") > 0)).alias("n_traction_metrics"), F.count_if(traction & (F.col("good") == 0)).alias("_metrics")
    )
    gaps = F.array_compact(F.array(
        F.when(F.col("_dropped") > 0, F.format_string("dropped %d hypothesis citation(s) not in the evidence set", "_dropped")), F.when(F.col("_metrics") > 0, F.format_string("dropped %d traction metric(s) with no resolvable evidence", "_metrics")),
        F.when(F.col("n_hypotheses") == 0, F.lit("required section missing: hypotheses")),
    ))
    return sums.select("memo_id", "n_hypotheses", "n_traction_metrics", ((F.col("_dropped") == 0) & (F.col("_metrics") == 0)).alias("all_citations_resolved"), (F.col("n_hypotheses") > 0).alias("required_sections_present"), F.array_join(gaps, "; ").alias("gaps"))
