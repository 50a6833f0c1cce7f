"""Queries over market research, screening, memos and the merging of what hangs on people and deals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import delivery as V
from ..operators import ledger as L
from ..operators import market as M
from ..operators import merge as G
from ..operators import repairs as R
from ..operators import screening as S
from ..operators import views as W
from ..operators.graph import shared_folder
from ..registry import query
from ..sources import domain as D
from ..sources import reference_data as T
from ..sources.domain import sql

# ---- market research ---------------------------------------------------------------------------------------------------------

_HITS = "SELECT o_custkey AS opportunity_id, CASE o_orderkey % 5 WHEN 0 THEN 'trend' WHEN 1 THEN 'sizing' WHEN 2 THEN 'competition' WHEN 3 THEN 'comparables' ELSE 'kpi' END AS subgoal, CAST(o_orderkey AS INT) AS pos, 'https://www.m' || (o_orderkey % 300) || '.test/' AS url FROM orders"
_ITEMS = """SELECT o_custkey AS opportunity_id, o_orderkey AS item_no, CASE o_orderkey % 4 WHEN 0 THEN 'sizing' WHEN 1 THEN 'competition' WHEN 2 THEN 'comparables' ELSE 'kpi' END AS extractor, CASE o_orderkey % 5 WHEN 0 THEN 'TAM' WHEN 1 THEN 'SOM' WHEN 2 THEN 'CAGR' ELSE 'users' END AS metric,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderkey % 90 || 'bn' END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'gap' ELSE 'reported' END AS basis, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE ' Rival ' || (o_orderkey % 6) END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'low end' END AS positioning,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 50 || 'm' END AS round_size, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'seed' END AS stage, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 0.5 END AS confidence, CAST(o_orderkey % 3 AS INT) AS c1, CAST(o_orderkey % 4 AS INT) AS c2 FROM orders"""
_MARKET = f"""WITH h AS ({_HITS}), x AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id, extractor ORDER BY goal, pos0) - 1 AS pos FROM (SELECT opportunity_id, CASE WHEN subgoal IN ('sizing', 'trend') THEN 'sizing' ELSE subgoal END AS extractor, CASE WHEN subgoal = 'trend' THEN 2 ELSE 1 END AS goal, pos AS pos0, replace(url, 'www.', '') AS url FROM h)),
    i AS (SELECT *, CASE extractor WHEN 'sizing' THEN 'market_size' WHEN 'kpi' THEN 'market' WHEN 'competition' THEN 'competition' ELSE 'comparable' END AS category,
        CASE extractor WHEN 'sizing' THEN metric || ': ' || value || ' (' || basis || ')' WHEN 'kpi' THEN metric || ' benchmark: ' || value WHEN 'competition' THEN 'Competitor: ' || trim(name) || coalesce(' — ' || positioning, '') ELSE 'Comparable: ' || trim(name) || ' raised ' || coalesce(round_size, 'undisclosed amount') || ' (' || coalesce(stage, 'stage n/a') || ')' END AS statement,
        CASE extractor WHEN 'sizing' THEN 'market_size:' || lower(metric) WHEN 'kpi' THEN 'kpi:' || lower(metric) WHEN 'competition' THEN 'competitor:' || lower(trim(name)) ELSE 'comparable:' || lower(trim(name)) END AS dedup_key, CASE WHEN extractor = 'competition' THEN 0.8 ELSE coalesce(confidence, 0.7) END AS relevance
        FROM ({_ITEMS}) WHERE CASE WHEN extractor IN ('sizing', 'kpi') THEN basis <> 'gap' AND value <> '' ELSE trim(name) <> '' END),
    c AS (SELECT i.*, x.url FROM (SELECT *, unnest([c1, c2]) AS cited, unnest([0, 1]) AS nth FROM i) i JOIN x ON x.opportunity_id = i.opportunity_id AND x.extractor = i.extractor AND x.pos = i.cited),
    claims AS (SELECT opportunity_id, dedup_key, arg_min(category, (item_no, nth)) AS category, arg_min(statement, (item_no, nth)) AS statement, min(item_no) AS item_no, count(DISTINCT url) AS n_sources FROM c GROUP BY opportunity_id, dedup_key)"""


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = sql(spark, sf_dir, _ITEMS).withColumn("citations", F.array("c1", "c2")).withColumn("confidence", F.col("confidence").cast("double"))
    return M.claims(items, sql(spark, sf_dir, _HITS))


@query(f"{_MARKET} SELECT opportunity_id, dedup_key, category, statement, n_sources FROM claims")
def market_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from extracted market items, with citations resolved against what each extractor saw."""
    return _market(spark, sf_dir)[0].select("opportunity_id", "dedup_key", "category", "statement", "n_sources")


@query(f"{_MARKET} SELECT opportunity_id, dedup_key, url AS canonical_url, CAST(arg_min(relevance, (item_no, nth)) AS DOUBLE) AS relevance FROM c GROUP BY opportunity_id, dedup_key, url")
def market_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir)[1]


@query(
    f"""{_MARKET}, s AS (SELECT *, CASE category WHEN 'competition' THEN split_part(substr(statement, 13), ' — ', 1) WHEN 'comparable' THEN split_part(substr(statement, 13), ' raised ', 1) ELSE statement END AS t, CASE split_part(statement, ': ', 1) WHEN 'TAM' THEN 1 WHEN 'SAM' THEN 2 WHEN 'SOM' THEN 3 WHEN 'CAGR' THEN 4 ELSE 10 END AS r FROM claims)
    SELECT opportunity_id, coalesce(string_agg(t, '; ' ORDER BY r, item_no) FILTER (WHERE category = 'market_size'), '') AS sizing, coalesce(string_agg(t, '; ' ORDER BY item_no) FILTER (WHERE category = 'market'), '') AS kpi, coalesce(string_agg(t, '; ' ORDER BY item_no) FILTER (WHERE category = 'competition'), '') AS competitors,
    coalesce(string_agg(t, '; ' ORDER BY item_no) FILTER (WHERE category = 'comparable'), '') AS comparables, count(*) AS n_claims FROM s GROUP BY opportunity_id"""
)
def market_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.analysis(_market(spark, sf_dir)[0])


@query(f"SELECT opportunity_id, string_agg(metric || ': not found / unverified', '; ' ORDER BY CASE extractor WHEN 'sizing' THEN 0 ELSE 1 END, item_no) AS gaps, count(*) AS n_gaps FROM ({_ITEMS}) WHERE basis = 'gap' AND extractor IN ('sizing', 'kpi') GROUP BY opportunity_id")
def market_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gaps(sql(spark, sf_dir, _ITEMS))


@query(f"SELECT 'https://m' || k || '.test/' AS canonical_url, 'market' AS kind, opportunity_id, subgoal FROM (SELECT CAST(regexp_extract(url, 'm([0-9]+)', 1) AS INT) AS k, arg_min(opportunity_id, (opportunity_id, subgoal, pos)) AS opportunity_id, arg_min(subgoal, (opportunity_id, subgoal, pos)) AS subgoal FROM ({_HITS}) GROUP BY 1) WHERE k >= 100")
def new_market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose page is not stored yet, once each."""
    known = spark.range(100).select(F.concat(F.lit("https://m"), F.col("id").cast("string"), F.lit(".test/")).alias("canonical_url"))
    return M.new_signals(sql(spark, sf_dir, _HITS), known).select("canonical_url", "kind", "opportunity_id", "subgoal")


_OLD = "SELECT opportunity_id, dedup_key, min(statement) AS statement FROM (SELECT o_custkey AS opportunity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'market_size:tam' ELSE 'kpi:none' END AS dedup_key, 'old' AS statement FROM orders WHERE o_custkey % 2 = 0) o GROUP BY opportunity_id, dedup_key"


@query(f"{_MARKET}, old AS ({_OLD}) SELECT opportunity_id, dedup_key, coalesce(c.statement, old.statement) AS statement FROM old FULL JOIN (SELECT opportunity_id, dedup_key, statement FROM claims) c USING (opportunity_id, dedup_key)")
def market_claims_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market claims after another run: one per key, the new statement where there is one."""
    return M.upserted_claims(sql(spark, sf_dir, _OLD), _market(spark, sf_dir)[0])


_FIGURES = """SELECT o_orderkey AS claim_id, o_custkey AS opportunity_id, CASE o_orderkey % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'market_size' ELSE 'competition' END AS category, '{"metric": "' || CASE o_orderkey % 4 WHEN 0 THEN 'tam' WHEN 1 THEN 'SOM' ELSE 'users' END || '", "value": "' || o_orderkey || '", "confidence": 0.5}' AS attributes, round(o_totalprice / 600000, 3) AS trust, 'unverified' AS status FROM orders"""
_CITES = "SELECT l_orderkey AS claim_id, l_suppkey AS signal_id, CASE WHEN l_returnflag = 'R' THEN 'refutes' ELSE 'supports' END AS stance FROM lineitem"
_SITES = "SELECT s_suppkey AS signal_id, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://e.test/' || (s_suppkey % 30) END AS url, s_suppkey % 7 AS created_at FROM supplier"


@query(
    f"""WITH f AS ({_FIGURES}), u AS (SELECT claim_id, arg_min(url, (created_at, signal_id)) AS url FROM ({_CITES}) JOIN ({_SITES}) USING (signal_id) WHERE url IS NOT NULL GROUP BY claim_id) SELECT opportunity_id, claim_id, CASE category WHEN 'market' THEN 'kpi' ELSE 'sizing' END AS section,
    CASE claim_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END AS rank, CASE claim_id % 4 WHEN 0 THEN 'tam' WHEN 1 THEN 'SOM' ELSE 'users' END AS metric, CAST(claim_id AS VARCHAR) AS value, trust, status, url FROM f LEFT JOIN u USING (claim_id) WHERE category <> 'competition'"""
)
def market_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures read out of claims' attributes, each with one URL."""
    urls = M.first_urls(sql(spark, sf_dir, _CITES), sql(spark, sf_dir, _SITES))
    return M.figures(sql(spark, sf_dir, _FIGURES), urls).select("opportunity_id", "claim_id", "section", "rank", "metric", "value", "trust", "status", "url")


_ANY_SHAPE = """SELECT o_orderkey AS claim_id, o_custkey AS opportunity_id, CASE o_orderkey % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'market_size' ELSE 'competition' END AS category, CASE o_orderkey % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN 'no json' ELSE '{"metric": "' || CASE o_orderkey % 4 WHEN 0 THEN 'cagr' ELSE 'users' END || '", "value": ' || o_orderkey ||
    ', "unit": "u' || (o_orderkey % 7) || '", "confidence": 0.5, "year": ' || (o_orderkey % 13) || ', "range": {"low": ' || (o_orderkey % 11) || ', "parts": [1, "x"]}}' END AS attributes, round(o_totalprice / 600000, 3) AS trust, 'unverified' AS status FROM orders"""


@query(
    f"""SELECT opportunity_id, claim_id, CASE category WHEN 'market' THEN 'kpi' ELSE 'sizing' END AS section, CASE WHEN ok AND claim_id % 4 = 0 THEN 4 ELSE 10 END AS rank, CASE WHEN ok THEN CASE claim_id % 4 WHEN 0 THEN 'cagr' ELSE 'users' END END AS metric, CASE WHEN ok THEN CAST(claim_id AS VARCHAR) END AS value, CASE WHEN ok THEN 'u' || (claim_id % 7) END AS unit,
    CASE WHEN ok THEN 0.5 END AS confidence, CASE WHEN ok THEN 'range={{"low":' || (claim_id % 11) || ',"parts":[1,"x"]}};year=' || (claim_id % 13) END AS more FROM (SELECT *, claim_id % 5 > 1 AS ok FROM ({_ANY_SHAPE})) WHERE category <> 'competition'"""
)
def market_figures_of_any_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures out of attributes of any shape: units and fields nobody foresaw survive, what is no object keeps its claim."""
    urls = M.first_urls(sql(spark, sf_dir, _CITES), sql(spark, sf_dir, _SITES))
    rows = M.figures_of_any_shape(sql(spark, sf_dir, _ANY_SHAPE), urls)
    more = F.array_join(F.transform(F.array_sort(F.map_entries("more")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return rows.select("opportunity_id", "claim_id", "section", "rank", "metric", "value", "unit", "confidence", more.alias("more"))


@query(f"SELECT o_custkey AS founder_id, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls, count(DISTINCT url) AS n_urls FROM orders JOIN ({_CITES}) ON claim_id = o_orderkey AND stance = 'supports' JOIN ({_SITES}) USING (signal_id) WHERE url IS NOT NULL GROUP BY o_custkey")
def founder_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different pages that support each founder's claims."""
    cited = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("founder_id"), F.col("o_orderkey").alias("claim_id"))
    return S.provenance(cited, sql(spark, sf_dir, _CITES), sql(spark, sf_dir, _SITES), "founder_id", supports_only=True)


_AXES = "SELECT o_orderkey AS opportunity_id, 'market' AS axis, CAST(o_orderkey % 37 AS DOUBLE) AS score, 'neutral' AS verdict, 0.5 AS confidence, 'stable' AS trend, 'r' || o_orderkey AS rationale FROM orders WHERE o_orderkey % 3 = 0"


@query(D.with_views("opportunity", sql=f"SELECT opportunity_id, sector, verdict, score, trend FROM opportunity JOIN ({_AXES}) USING (opportunity_id)"))
def researched_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals with a market axis."""
    return M.researched(D.opportunities(spark, sf_dir), sql(spark, sf_dir, _AXES)).select("opportunity_id", "sector", "verdict", "score", "trend")


@query("SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0")
def researchable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for research that name a subject."""
    k = F.col("o_orderkey")
    rows = D.table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 3 == 0, "idea").alias("idea"), F.when(k % 5 != 0, "sector").otherwise(" ").alias("sector"))
    return M.researchable(rows).select("request_id")


# ---- screening -----------------------------------------------------------------------------------------------------------------


@query(
    D.with_views(
        "opportunity",
        sql=f""", old AS ({_AXES}), new AS (SELECT opportunity_id, 'founder' AS axis, CAST(founder_id % 60 AS DOUBLE) AS score, 'bull' AS verdict FROM opportunity WHERE founder_id % 2 = 0 UNION ALL SELECT opportunity_id, 'market', CAST(opportunity_id % 41 AS DOUBLE), 'bear' FROM opportunity WHERE opportunity_id % 3 <> 0
        UNION ALL SELECT opportunity_id, 'idea', CAST(opportunity_id % 29 AS DOUBLE), 'neutral' FROM opportunity WHERE opportunity_id % 5 <> 0) SELECT opportunity_id, axis, score, verdict, 'stable' AS trend FROM old UNION ALL SELECT opportunity_id, axis, score, verdict, 'stable' FROM new""",
    )
)
def screened_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes side by side for every deal screened; a market axis that is there is kept."""
    deals = D.opportunities(spark, sf_dir)
    half = F.lit(0.5).alias("confidence")
    founder = deals.filter("founder_id % 2 = 0").select("founder_id", (F.col("founder_id") % 60).cast("double").alias("score"), F.lit("bull").alias("verdict"), half).distinct()
    market = deals.select("opportunity_id", (F.col("opportunity_id") % 41).cast("double").alias("score"), F.lit("bear").alias("verdict"), half)
    idea = deals.filter("opportunity_id % 5 <> 0").select("opportunity_id", (F.col("opportunity_id") % 29).cast("double").alias("score"), F.lit("neutral").alias("verdict"), half)
    old = sql(spark, sf_dir, _AXES).select("opportunity_id", "axis", "score", "verdict", F.col("confidence").cast("double").alias("confidence"), "trend")
    return S.screened(deals, old, founder, market, idea)[0].select("opportunity_id", "axis", "score", "verdict", "trend")


@query(
    D.with_views(
        "opportunity", "claim",
        sql=f""", d AS (SELECT * FROM opportunity WHERE sector <> '5-low'), a AS ({_AXES}) SELECT opportunity_id, coalesce(f.n, 0) AS n_founder_claims, coalesce(m.n, 0) AS n_market_claims, 'verdict=' || a.verdict || ', score=' || a.score || ': ' || a.rationale AS market_summary FROM d LEFT JOIN (SELECT founder_id, count(*) AS n FROM claim GROUP BY founder_id) f USING (founder_id)
        LEFT JOIN (SELECT claim_id % 3000 AS opportunity_id, count(*) AS n FROM claim GROUP BY 1) m USING (opportunity_id) LEFT JOIN a USING (opportunity_id)""",
    )
)
def idea_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each deal's idea is judged on: claims of its founder and of its market, and the market axis."""
    deals = D.opportunities(spark, sf_dir).withColumn("idea", F.lit(None).cast("string")).withColumn("sector", F.when(F.col("sector") != "5-low", F.col("sector")))
    claims = D.claims(spark, sf_dir).select("claim_id", "founder_id", (F.col("claim_id") % 3000).alias("opportunity_id"), F.col("category").alias("statement"), "category", F.col("impact").alias("trust"))
    return S.evidence_for_idea(deals, claims, sql(spark, sf_dir, _AXES))[1].select("opportunity_id", "n_founder_claims", "n_market_claims", "market_summary")


@query(D.with_views("claim", sql="SELECT founder_id, '## Founder' || chr(10) || string_agg('[' || claim_id || '] (' || category || ', trust=None) claim ' || claim_id, chr(10) ORDER BY claim_id) AS block, count(*) AS n_claims FROM claim GROUP BY founder_id"))
def founder_claim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each founder's claims as one text for a reader."""
    claims = D.claims(spark, sf_dir).withColumn("trust", F.lit(None).cast("double")).withColumn("statement", F.concat_ws(" ", F.lit("claim"), F.col("claim_id").cast("string")))
    return S.claim_blocks(claims, "founder_id", "Founder")


@query("SELECT o_custkey AS opportunity_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS memo_id, arg_max(lower(o_orderpriority), (o_orderdate, o_orderkey)) AS recommendation, CASE WHEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 2 = 0 THEN 1 ELSE 0 END AS n_gaps FROM orders GROUP BY o_custkey")
def memo_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each deal's latest memo."""
    k = F.col("o_orderkey")
    memos = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("opportunity_id"), k.alias("memo_id"), F.col("o_orderdate").alias("generated_at"), F.lower("o_orderpriority").alias("recommendation"), F.when(k % 2 == 0, F.array(F.lit("cap table"))).alias("gaps"))
    return S.memo_view(memos).select("opportunity_id", "memo_id", "recommendation", F.size("gaps").alias("n_gaps"))


@query("SELECT 'name' AS field, r_name AS value FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'geo', 'R2' UNION ALL SELECT 'stage', 'seed'")
def thesis_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default thesis after an update, by field; the seeds that were there already add nothing."""
    text = lambda c: F.col(c).cast("string")
    stored = D.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("thesis_id"), text("r_name").alias("name"), F.lit(None).cast("string").alias("geo"), F.lit("seed").alias("stage"), (F.col("r_regionkey") == 2).alias("is_default"))
    update = stored.filter("thesis_id = 2").withColumn("geo", F.lit("R2")).drop("is_default")
    seeded = stored.unionByName(T.missing_rows(stored, stored, "thesis_id"))
    now = T.updated_thesis(seeded, update)
    return W.thesis_lines(T.default_thesis(now, now.limit(0)))


@query("SELECT r_name AS name FROM region WHERE r_regionkey % 2 = 0")
def enabled_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels after the dimension was replaced: the enabled ones."""
    old = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("web").alias("fetcher"), F.lit(True).alias("enabled"))
    new = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("hn").alias("fetcher"), (F.col("r_regionkey") % 2 == 0).alias("enabled"))
    return T.enabled(T.replaced(old, new)).select("name")


# ---- what hangs on people, deals and claims --------------------------------------------------------------------------------------

_MAP = "SELECT c_custkey AS id, c_custkey - c_custkey % 3 AS canonical FROM customer"


@query("SELECT o_custkey - o_custkey % 3 AS founder_id, o_orderkey % 97 AS signal_id, max(round(o_totalprice / 600000, 3)) AS confidence, strftime(min(o_orderdate), '%Y-%m-%d') AS attributed_on, arg_min(lower(o_orderpriority), (o_orderdate, lower(o_orderpriority))) AS method FROM orders GROUP BY 1, 2")
def folded_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution edges after every three founders became one."""
    edges = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("founder_id"), (F.col("o_orderkey") % 97).alias("signal_id"), F.round(F.col("o_totalprice") / 600000, 3).alias("confidence"), F.col("o_orderdate").alias("attributed_at"), F.lower("o_orderpriority").alias("method"))
    return G.fold_attributions(G.rekeyed(edges, sql(spark, sf_dir, _MAP))).select("founder_id", "signal_id", "confidence", F.date_format("attributed_at", "yyyy-MM-dd").alias("attributed_on"), "method")


@query("SELECT DISTINCT c_custkey - c_custkey % 3 AS founder_id, 'github' AS kind, 'g' || (c_custkey % 50) AS value FROM customer WHERE c_custkey % 7 <> 0")
def folded_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles after the merge: each once, empty rows gone."""
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(k.alias("founder_id"), F.lit("github").alias("kind"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("g"), (k % 50).cast("string"))).alias("value"))
    return G.fold_identities(G.rekeyed(rows, sql(spark, sf_dir, _MAP)))


_LINKS = "SELECT o_custkey AS founder_id, o_orderkey % 20 AS company_id, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 3 = 1 THEN '' END AS role, o_orderdate AS linked_at FROM orders"


@query(f"SELECT founder_id - founder_id % 3 AS founder_id, company_id, arg_min(role, (linked_at, role)) FILTER (WHERE role <> '') AS role, strftime(min(linked_at), '%Y-%m-%d') AS linked_on FROM ({_LINKS}) GROUP BY 1, 2")
def folded_company_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.fold_company_links(G.rekeyed(sql(spark, sf_dir, _LINKS), sql(spark, sf_dir, _MAP)))
    return rows.select("founder_id", "company_id", "role", F.date_format("linked_at", "yyyy-MM-dd").alias("linked_on"))


@query(f"SELECT founder_id, company_id, coalesce(arg_min(role, (linked_at, role)) FILTER (WHERE role <> '' AND company_id % 2 = 0), CASE WHEN bool_or(company_id % 2 = 1 OR company_id % 3 = 0) THEN 'founder' END) AS role FROM ({_LINKS}) GROUP BY founder_id, company_id")
def linked_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founder-company links after more of them: a pair once, an empty role filled in."""
    rows = sql(spark, sf_dir, _LINKS)
    new = rows.filter("company_id % 2 = 1 or company_id % 3 = 0").select("founder_id", "company_id", F.lit("founder").alias("role"), "linked_at")
    return G.linked_companies(rows.filter("company_id % 2 = 0"), new).select("founder_id", "company_id", "role")


@query("SELECT id - id % 3 AS founder_id, lower(n) AS normalized_name, min(n) AS alias FROM (SELECT c_custkey AS id, 'Alias ' || (c_custkey % 10) AS n FROM customer UNION ALL SELECT c_custkey, 'Person ' || (c_custkey % 10) FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1, 2")
def folded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names people go by after the merge, the duplicates' own among them."""
    k = F.col("c_custkey")
    named = lambda word: F.concat(F.lit(f"{word} "), (k % 10).cast("string"))
    rows = D.table(spark, sf_dir, "customer")
    aliases = rows.select(k.alias("founder_id"), named("Alias").alias("alias"), F.lower(named("Alias")).alias("normalized_name"))
    return G.fold_aliases(aliases, sql(spark, sf_dir, _MAP), rows.select(k.alias("id"), named("Person").alias("display_name")))


@query("WITH d AS (SELECT o_orderkey AS id, o_orderkey - o_orderkey % 4 AS survivor FROM orders), a AS (SELECT id, survivor, CASE WHEN id % 5 < 2 THEN 'founder' WHEN id % 5 < 4 THEN 'market' ELSE 'idea' END AS axis FROM d) SELECT survivor AS opportunity_id, axis, CAST(arg_min(id, (CASE WHEN id = survivor THEN 0 ELSE 1 END, id)) AS DOUBLE) AS score FROM a GROUP BY survivor, axis")
def folded_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of folded deals: the survivor's stand, those it lacks come across."""
    k = F.col("o_orderkey")
    orders = D.table(spark, sf_dir, "orders")
    deals = orders.select(k.alias("opportunity_id"), (k - k % 4).alias("survivor"), k.alias("created_at"))
    axes = orders.select(k.alias("opportunity_id"), F.when(k % 5 < 2, "founder").when(k % 5 < 4, "market").otherwise("idea").alias("axis"), k.cast("double").alias("score"), F.lit("bull").alias("verdict"))
    return G.fold_axes(axes, deals).select("opportunity_id", "axis", "score")


@query("SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 2 = 0 THEN 'sector' ELSE m.sector END AS sector, m.geo AS geo, 'd' || s_suppkey AS domain FROM supplier LEFT JOIN (SELECT o_orderkey % 97 AS company_id, arg_min(lower(o_orderpriority), o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS sector, arg_min('g' || o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 5 = 0) AS geo FROM orders GROUP BY 1) m ON company_id = s_suppkey")
def enriched_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies filled from later mentions, nothing overwritten."""
    k, o, none = F.col("s_suppkey"), F.col("o_orderkey"), F.lit(None).cast("string")
    known = D.table(spark, sf_dir, "supplier").select(k.alias("company_id"), none.alias("name_key"), F.concat(F.lit("d"), k.cast("string")).alias("domain"), none.alias("website"), F.when(k % 2 == 0, "sector").otherwise("").alias("sector"), none.alias("geo"), none.alias("description"))
    met = D.table(spark, sf_dir, "orders").select((o % 97).alias("company_id"), o.alias("mention_id"), none.alias("name_key"), F.lit("other").alias("domain"), none.alias("website"), F.when(o % 3 == 0, F.lower("o_orderpriority")).otherwise("").alias("sector"), F.when(o % 5 == 0, F.concat(F.lit("g"), o.cast("string"))).alias("geo"), none.alias("description"))
    return G.enriched_companies(known, met).select("company_id", "sector", "geo", "domain")


@query(
    """WITH x AS (SELECT o_custkey AS founder_id, o_orderkey AS claim_no, CASE o_orderkey % 3 WHEN 0 THEN 'research' ELSE 'media' END AS category, CASE WHEN o_orderkey % 4 <> 0 THEN 'k' || (o_orderkey % 6) END AS dedup_key FROM orders),
    e AS (SELECT o_custkey AS founder_id, 'k' || (o_orderkey % 6) AS dedup_key, min(o_orderkey) AS claim_id FROM orders WHERE o_orderkey % 6 < 3 GROUP BY 1, 2)
    SELECT x.founder_id, x.claim_no, coalesce(e.claim_id, r.claim_id) AS claim_id, CASE WHEN coalesce(e.claim_id, r.claim_id) IS NULL THEN 'mint' ELSE 'attach' END AS action FROM x LEFT JOIN e ON e.founder_id = x.founder_id AND e.dedup_key = x.dedup_key
    LEFT JOIN e r ON r.founder_id = x.founder_id AND r.dedup_key = 'k' || (x.claim_no % 3) AND x.claim_no % 2 = 0 AND x.category = CASE WHEN r.claim_id % 3 = 0 THEN 'research' ELSE 'media' END"""
)
def matched_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where extracted claims go: to the claim of their key, to the one a reviewer names in their category, or to a new one."""
    o = F.col("o_orderkey")
    kind = lambda k: F.when(k % 3 == 0, "research").otherwise("media")
    orders = D.table(spark, sf_dir, "orders")
    extracted = orders.select(F.col("o_custkey").alias("founder_id"), o.alias("claim_no"), kind(o).alias("category"), F.when(o % 4 != 0, F.concat(F.lit("k"), (o % 6).cast("string"))).alias("dedup_key"))
    existing = orders.filter("o_orderkey % 6 < 3").groupBy(F.col("o_custkey").alias("founder_id"), F.concat(F.lit("k"), (o % 6).cast("string")).alias("dedup_key")).agg(F.min("o_orderkey").alias("claim_id"))
    existing = existing.withColumn("category", kind(F.col("claim_id")))
    named = existing.select("founder_id", F.col("dedup_key").alias("_k"), F.col("claim_id").alias("existing_claim_id"))
    decisions = extracted.filter("claim_no % 2 = 0").withColumn("_k", F.concat(F.lit("k"), (F.col("claim_no") % 3).cast("string"))).join(named, ["founder_id", "_k"]).select("founder_id", "claim_no", F.lit("match").alias("action"), "existing_claim_id")
    return C.matched(extracted, existing, decisions)


@query(D.with_views("signal", sql="SELECT founder_id, signal_id FROM signal WHERE signal_id % 5 = 0 AND signal_id % 4 <> 0"))
def attributions_to_lose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions only the legacy column has: what must be empty before it may go."""
    s = D.signals(spark, sf_dir)
    legacy = s.withColumn("founder_id", F.when(F.col("signal_id") % 5 == 0, F.col("founder_id")))
    return R.lost_without_column(legacy, s.filter("signal_id % 4 = 0").select("founder_id", "signal_id")).select("founder_id", "signal_id")


@query(D.with_views("signal", sql="SELECT signal_id % 700 AS signal_id, min(founder_id) AS founder_id FROM signal GROUP BY 1 HAVING count(DISTINCT founder_id) = 1"))
def sole_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of exactly one founder, for the way back to a column."""
    return R.sole_owners(D.signals(spark, sf_dir).select((F.col("signal_id") % 700).alias("signal_id"), "founder_id")).select("signal_id", "founder_id")


@query(D.with_views("signal", sql="SELECT founder_id, CAST(floor((n - 1) / 50) AS INT) AS part, count(*) AS n, min(signal_id) AS first_id, max(signal_id) AS last_id FROM (SELECT founder_id, signal_id, row_number() OVER (PARTITION BY founder_id ORDER BY signal_id) AS n FROM signal) GROUP BY 1, 2"))
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a step: all evidence of each founder, in rows of bounded size."""
    rows = V.trace_rows(D.signals(spark, sf_dir).select("founder_id", "signal_id"), "sourcing", 50)
    return rows.select("founder_id", "part", F.size("evidence").cast("long").alias("n"), F.array_min("evidence").alias("first_id"), F.array_max("evidence").alias("last_id"))


_KINDS = ("sizing", "competition", "comparables", "kpi")


@query(
    D.with_views(
        "founder", "signal",
        sql=f"""SELECT 'discovery' AS source, unnest(['queries_run', 'raw_hits', 'candidates_extracted', 'new_founders', 'needs_review', 'new_signals']) AS metric, unnest([(SELECT count(*) FROM benchmark), (SELECT count(*) FROM ({_HITS})), (SELECT count(*) FROM part), (SELECT count(*) FROM founder), (SELECT count(*) FROM founder WHERE status = 'watchlist'), (SELECT count(*) FROM signal)]) AS n
        UNION ALL SELECT 'market', unnest(['queries_run', 'hits', 'sizing_figures', 'competitors', 'comparables', 'kpi_benchmarks']), unnest([(SELECT count(*) FROM benchmark), (SELECT count(*) FROM ({_HITS})), {", ".join(f"(SELECT count(*) FROM ({_ITEMS}) WHERE extractor = '{k}')" for k in _KINDS)}])
        UNION ALL SELECT 'claims', unnest(['founders_processed', 'cold_founders', 'new_signals', 'evidence_attached']), unnest([count(*), count(*) FILTER (WHERE founder_id % 4 = 0), CAST(sum(n_claims) AS BIGINT), CAST(sum(founder_id % 4) AS BIGINT)]) FROM (SELECT o_custkey AS founder_id, count(*) AS n_claims FROM orders GROUP BY o_custkey)""",
    )
)
def run_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger rows of a discovery, a market and a claims run, a line for each count; all were taken while writing."""
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    t = lambda name: D.table(spark, sf_dir, name)
    hits = sql(spark, sf_dir, _HITS)
    founders = D.founders(spark, sf_dir).withColumn("status", F.when(F.col("status") == "watchlist", "needs_review").otherwise(F.col("status")))
    runs = t("orders").groupBy(F.col("o_custkey").alias("founder_id")).agg(F.count("*").alias("minted")).withColumns({"mode": F.when(F.col("founder_id") % 4 == 0, "cold").otherwise("warm"), "attached": F.col("founder_id") % 4})
    rows = L.run(spark, "discovery", {"queries": t("benchmark"), "hits": hits, "candidates": t("part"), "founders": founders, "signals": D.signals(spark, sf_dir)}, L.discovery_counts(), f"{folder}/discovery")
    rows = rows.unionByName(L.run(spark, "market", {"queries": t("benchmark"), "hits": hits, "items": sql(spark, sf_dir, _ITEMS)}, L.market_counts(), f"{folder}/market"))
    rows = rows.unionByName(L.run(spark, "claims", {"runs": runs}, L.claims_counts(), f"{folder}/claims"))
    return rows.filter("started_at <= finished_at").select("source", F.explode("counts").alias("metric", "n"))


@query(D.with_views("signal", "founder", sql="SELECT 'discovery' AS source, (SELECT count(*) FROM signal) AS signals, (SELECT count(*) FROM founder) AS founders, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS claims"))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row of a run."""
    counts = {"signals": D.signals(spark, sf_dir), "founders": D.founders(spark, sf_dir), "claims": D.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0")}
    return V.run_metrics("discovery", counts, D.as_of()).drop("finished_at")


@query(
    """WITH c AS (SELECT l_suppkey AS memo_id, CASE WHEN l_linenumber <= 4 THEN 'hypothesis' ELSE 'traction' END AS part, l_linenumber AS point_no, count(*) FILTER (WHERE l_orderkey % 3 <> 1) AS good, count(*) FILTER (WHERE l_orderkey % 3 = 1) AS bad FROM lineitem WHERE l_suppkey % 2 = 0 OR l_linenumber > 4 GROUP BY 1, 2, 3),
    s AS (SELECT memo_id, count(*) FILTER (WHERE part = 'hypothesis') AS h, CAST(coalesce(sum(bad) FILTER (WHERE part = 'hypothesis'), 0) AS BIGINT) AS d, count(*) FILTER (WHERE part = 'traction' AND good > 0) AS t, count(*) FILTER (WHERE part = 'traction' AND good = 0) AS m FROM c GROUP BY memo_id)
    SELECT memo_id, h AS n_hypotheses, t AS n_traction_metrics, d = 0 AND m = 0 AS all_citations_resolved, h > 0 AS required_sections_present, concat_ws('; ', CASE WHEN d > 0 THEN 'dropped ' || d || ' hypothesis citation(s) not in the evidence set' END, CASE WHEN m > 0 THEN 'dropped ' || m || ' traction metric(s) with no resolvable evidence' END, CASE WHEN h = 0 THEN 'required section missing: hypotheses' END) AS gaps FROM s"""
)
def memo_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What memos' hypotheses and metrics rest on."""
    items = D.table(spark, sf_dir, "lineitem")
    used = items.filter("l_suppkey % 2 = 0 or l_linenumber > 4")  # memos of odd number have no hypotheses
    points = used.select(F.col("l_suppkey").alias("memo_id"), F.when(F.col("l_linenumber") <= 4, "hypothesis").otherwise("traction").alias("part"), F.col("l_linenumber").alias("point_no"), F.array("l_orderkey").alias("cited"))
    return S.memo_quality(points, items.filter("l_orderkey % 3 <> 1").select(F.col("l_orderkey").alias("claim_id")))


@query(
    """WITH c AS (SELECT s_suppkey AS company_id, 'firm ' || (s_suppkey % 30) AS k, s_suppkey AS created_at FROM supplier), d AS (SELECT o_orderkey AS opportunity_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END AS company_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'firm ' || (o_orderkey % 33) END AS k FROM orders),
    s AS (SELECT company_id, k, first_value(company_id) OVER (PARTITION BY k ORDER BY (company_id IN (SELECT company_id FROM d WHERE company_id IS NOT NULL)) DESC, created_at, company_id) AS survivor FROM c)
    SELECT opportunity_id, CASE WHEN d.company_id IS NOT NULL THEN CAST(coalesce(s.survivor, d.company_id) AS VARCHAR) WHEN d.k IS NOT NULL THEN coalesce(CAST(n.survivor AS VARCHAR), 'new-' || substr(sha256(d.k), 1, 16)) END AS company_id FROM d LEFT JOIN s ON s.company_id = d.company_id LEFT JOIN (SELECT DISTINCT k, survivor FROM s) n ON n.k = d.k"""
)
def deals_of_deduplicated_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals after companies became one per name: repointed, and named ones given their company."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    companies = D.table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.concat(F.lit("Firm "), (k % 30).cast("string"), F.when(k % 2 == 0, " GmbH").otherwise(", Inc.")).alias("name"), k.alias("created_at"))
    orders = D.table(spark, sf_dir, "orders")
    deals = orders.select(o.alias("opportunity_id"), F.when(o % 3 != 0, o % 50).alias("company_id"), F.when(o % 4 != 0, F.concat(F.lit("FIRM "), (o % 33).cast("string"))).alias("company_name"))
    links = orders.select(F.col("o_custkey").alias("founder_id"), (o % 50).alias("company_id"), F.lit("founder").alias("role"), F.col("o_orderdate").alias("linked_at"))
    return G.deduplicated_companies(companies, deals, links)[1].select("opportunity_id", "company_id")
