"""Queries over deliveries, market research and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery as V
from ..operators import ingest as I
from ..operators import market as M
from ..operators import repairs as R
from ..registry import query
from ..sources import domain as D


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A view in SQL over the driver's tables."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: D.table(spark, sf_dir, t) for t in tables})


_TEXTS = "SELECT doc_id AS founder_id, coalesce(text, '') || ' see https://github.com/Dev' || doc_id || ', and https://www.linkedin.com/in/In-' || (doc_id % 50) || '/ or x.com/i and https://x.com/Tw' || doc_id AS text FROM documents"


_FOUND = rf"""SELECT founder_id, kind, arg_min(value, pos) AS value FROM (SELECT founder_id, pos, CASE WHEN contains(raw, 'github.com') THEN 'github' WHEN contains(raw, 'linkedin.') THEN 'linkedin' ELSE 'twitter' END AS kind,
    CASE WHEN contains(raw, 'linkedin.') THEN regexp_extract(raw, 'linkedin\.[a-z]+/(?:in|pub)/([^/?#]{{3,100}})', 1) WHEN contains(raw, 'github.com') THEN regexp_extract(raw, '//(?:www\.)?github\.com/([a-z0-9-]+)', 1) ELSE regexp_extract(raw, '(?:^|//)(?:www\.)?(?:x|twitter)\.com/([a-z0-9_]+)', 1) END AS value
    FROM (SELECT founder_id, lower(regexp_replace(unnest(refs), '[.,;:]+$', '')) AS raw, unnest(range(len(refs))) AS pos FROM (SELECT founder_id, regexp_extract_all(text, '(?i)https?://[^\s"''<>)\]}}]+|(?:www\.)?(?:github|linkedin|twitter|x)\.com/[^\s"''<>)\]}}]+') AS refs FROM ({_TEXTS})))
    WHERE contains(raw, 'github.com') OR contains(raw, 'linkedin.') OR regexp_matches(raw, '(^|[/.])(twitter|x)\.com')) WHERE value NOT IN ('', 'i') GROUP BY founder_id, kind"""


@query(_FOUND)
def profiles_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile references mined from each document's whole text, followed by planted ones."""
    n = F.col("doc_id")
    planted = F.concat(F.lit(" see https://github.com/Dev"), n, F.lit(", and https://www.linkedin.com/in/In-"), n % 50, F.lit("/ or x.com/i and https://x.com/Tw"), n)
    return V.mined_profiles(D.table(spark, sf_dir, "documents").select(n.alias("founder_id"), F.concat(F.coalesce("text", F.lit("")), planted).alias("text")))


@query(
    D.with_views(
        "signal",
        sql="""SELECT founder_id, n_signals, n_strong, round(least(0.95, 0.4 + 0.1 * n_signals + CASE WHEN n_strong > 0 THEN 0.2 ELSE 0.0 END), 2) AS discovery_confidence, CASE WHEN n_strong > 0 THEN 0.9 ELSE 0.7 END AS attribution_confidence, 'discovered' AS status FROM (
        SELECT founder_id, count(DISTINCT signal_id % 40) AS n_signals, CASE WHEN founder_id % 3 = 0 THEN 1 ELSE 0 END AS n_strong FROM signal GROUP BY founder_id)""",
    )
)
def assembled_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.signals(spark, sf_dir)
    rows = s.select("founder_id", F.concat(F.lit("https://www.e.test/p"), (F.col("signal_id") % 40).cast("string"), F.lit("?utm_source=x")).alias("url"), "source", F.col("signal_id").alias("pos"))
    strong = s.filter("founder_id % 3 = 0").select("founder_id", F.lit("github").alias("kind"))
    return V.assembled(rows, strong)


_MET = "SELECT p_partkey AS founder_id, CASE p_partkey % 6 WHEN 0 THEN 'Buildathon 2025' WHEN 1 THEN 'Acme Ventures' WHEN 2 THEN 'solo' ELSE p_name END AS display_name FROM part"


@query(f"SELECT CASE WHEN founder_id % 6 < 3 THEN 'not_a_person' ELSE 'no_evidence' END AS reason, count(*) AS n FROM ({_MET}) WHERE founder_id % 6 < 3 OR founder_id % 4 = 0 GROUP BY 1")
def delivery_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many people of a delivery were refused, and why."""
    people = _sql(spark, sf_dir, _MET, "part")
    return V.gated(people, people.filter("founder_id % 4 <> 0"))[1]


@query("SELECT c_custkey AS founder_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE s END AS occupation, CASE WHEN k IS NULL THEN 0.5 ELSE greatest(0.5, k) END AS discovery_confidence FROM customer LEFT JOIN (SELECT o_custkey, max((o_orderkey % 10) / 10.0) AS k, arg_min(lower(o_orderpriority), o_orderkey) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def enriched_founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known founders filled up from a delivery's mentions."""
    none = F.lit(None).cast("string")
    known = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("founder_id"), F.lit(0.5).alias("discovery_confidence"), none.alias("city"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("occupation"), none.alias("current_company"))
    new = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("founder_id"), F.col("o_orderkey").alias("mention_id"), ((F.col("o_orderkey") % 10) / 10).alias("discovery_confidence"), none.alias("city"), F.lower("o_orderpriority").alias("occupation"), none.alias("current_company"))
    return V.enriched(known, new).select("founder_id", "occupation", "discovery_confidence")


@query(
    """SELECT doc_id, signal_id, matched_by, promoted FROM (SELECT d.doc_id, coalesce(u.signal_id, h.signal_id) AS signal_id, CASE WHEN u.signal_id IS NOT NULL THEN 'url' WHEN h.signal_id IS NOT NULL THEN 'hash' WHEN d.text IS NULL OR d.doc_id = min(CASE WHEN u.signal_id IS NULL THEN d.doc_id END) OVER (PARTITION BY d.text) THEN 'new' ELSE 'batch_hash' END AS matched_by, coalesce(coalesce(u.signal_id, h.signal_id) % 4 = 0, false) AS promoted
    FROM documents d LEFT JOIN (SELECT doc_id AS signal_id FROM documents WHERE doc_id % 3 = 0) u ON u.signal_id = d.doc_id LEFT JOIN (SELECT min(doc_id) AS signal_id, text FROM documents WHERE doc_id % 3 = 0 GROUP BY text) h ON h.text = d.text)"""
)
def materialised_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered artifacts against stored ones and each other: by URL, by content, or new."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://e.test/"), F.col("doc_id").cast("string")).alias("canonical_url"), F.sha2("text", 256).alias("content_hash"))
    stored = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("signal_id"), "canonical_url", "content_hash", F.when(F.col("doc_id") % 4 == 0, "market").otherwise("founder").alias("kind"))
    return I.materialised(docs, stored, ("doc_id",)).select("doc_id", "signal_id", "matched_by", "promoted")


@query("SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_groups(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name")))


@query(D.with_views("signal", sql="SELECT 'founder' AS what, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT founder_id FROM signal) UNION ALL SELECT 'signal', signal_id FROM signal WHERE signal_id % 3 <> 0 AND signal_id % 7 <> 0 AND signal_id % 10 <> 0"))
def orphaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founders without signals, and founder signals that nothing uses."""
    s = D.signals(spark, sf_dir)
    kinds = s.withColumn("kind", F.when(F.col("signal_id") % 10 == 0, "market").otherwise("founder"))
    bare, _ = V.orphans(D.founders(spark, sf_dir), s.select("founder_id", "signal_id"), kinds, s.limit(0))
    _, loose = V.orphans(D.founders(spark, sf_dir), s.filter("signal_id % 3 = 0").select("founder_id", "signal_id"), kinds, s.filter("signal_id % 7 = 0"))
    return bare.select(F.lit("founder").alias("what"), F.col("founder_id").alias("id")).unionByName(loose.select(F.lit("signal").alias("what"), F.col("signal_id").alias("id")))


_AXIS_ROWS = "SELECT o_orderkey AS opportunity_id, 'idea' AS axis, 'bear' AS verdict FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'founder', 'bull' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'market', 'neutral' FROM orders WHERE o_orderkey % 5 = 0"


@query(D.with_views("opportunity", sql=f"SELECT opportunity_id, string_agg(axis || '=' || verdict, ',' ORDER BY CASE axis WHEN 'founder' THEN 1 WHEN 'market' THEN 2 ELSE 3 END) AS axes, count(axis) AS n_axes FROM opportunity LEFT JOIN ({_AXIS_ROWS}) USING (opportunity_id) GROUP BY opportunity_id"))
def opportunity_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.axes_of(D.opportunities(spark, sf_dir).select("opportunity_id"), _sql(spark, sf_dir, _AXIS_ROWS, "orders"))


@query(D.with_views("signal", sql="SELECT founder_id, signal_id FROM signal WHERE signal_id % 9 <> 0 AND signal_id % 4 <> 0"))
def backfilled_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.signals(spark, sf_dir)
    legacy = s.withColumn("founder_id", F.when(F.col("signal_id") % 9 != 0, F.col("founder_id")))
    return R.backfilled_edges(legacy, s.filter("signal_id % 4 = 0").select("founder_id", "signal_id")).select("founder_id", "signal_id")


@query(D.with_views("signal", sql="SELECT kind, diverged, count(*) AS n FROM (SELECT CASE WHEN signal_id % 4 = 0 THEN 'founder' ELSE 'market' END AS kind, signal_id % 4 = 0 AND signal_type = 'error' AS diverged FROM signal) GROUP BY kind, diverged"))
def signal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.signals(spark, sf_dir)
    typed = s.withColumn("signal_type", F.when(F.col("signal_type") == "error", "market_research").otherwise(F.col("signal_type")))
    return R.with_kind(typed, s.filter("signal_id % 4 = 0")).groupBy("kind", "diverged").agg(F.count("*").alias("n"))


@query("SELECT 'github' AS kind, CASE c_custkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'rewritten' ELSE 'cleared' END AS outcome, count(*) AS n FROM customer GROUP BY 2")
def canonicalised_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the identity repair does to stored values."""
    n = F.col("c_custkey")
    value = F.when(n % 3 == 0, F.concat(F.lit("dev"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("https://github.com/Dev"), n.cast("string"))).otherwise("https://github.com/orgs/a")
    return R.canonical_identities(D.table(spark, sf_dir, "customer").select(n.alias("founder_id"), F.lit("github").alias("kind"), value.alias("value")))[1]


@query("SELECT c_custkey AS founder_id, 'twitter' AS kind, 'author' AS value FROM customer WHERE c_custkey % 3 = 0")
def lookalike_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles read off other sites' URLs."""
    n = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer")
    identities = rows.select(n.alias("founder_id"), F.lit("twitter").alias("kind"), F.lit("author").alias("value"))
    urls = rows.select(n.alias("founder_id"), F.explode(F.when(n % 3 == 0, F.array(F.lit("https://paperindex.com/author/a"))).when(n % 3 == 1, F.array(F.lit("https://paperindex.com/author/a"), F.lit("https://x.com/Author"))).otherwise(F.array(F.lit("https://e.test/author")))).alias("url"))
    return R.lookalike_handles(identities, urls)


@query("SELECT memo_id, count(*) FILTER (WHERE good > 0) AS anchored_sections, CAST(sum(good) AS BIGINT) AS citations, CAST(sum(bad) AS BIGINT) AS dropped, concat_ws(',', CASE WHEN coalesce(max(good) FILTER (WHERE section = 'team'), 0) = 0 THEN 'team' END, CASE WHEN coalesce(max(good) FILTER (WHERE section = 'market'), 0) = 0 THEN 'market' END) AS missing FROM (SELECT l_suppkey AS memo_id, CASE l_linenumber % 3 WHEN 0 THEN 'team' WHEN 1 THEN 'market' ELSE 'risks' END AS section, count(*) FILTER (WHERE l_orderkey % 3 = 0) AS good, count(*) FILTER (WHERE l_orderkey % 3 <> 0) AS bad FROM lineitem GROUP BY 1, 2) GROUP BY memo_id")
def memo_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos' citations held against the claims there are."""
    from ..operators.screening import memo_anchors as anchors

    items = D.table(spark, sf_dir, "lineitem")
    section = F.when(F.col("l_linenumber") % 3 == 0, "team").when(F.col("l_linenumber") % 3 == 1, "market").otherwise("risks")
    sections = items.select(F.col("l_suppkey").alias("memo_id"), section.alias("section"), F.array("l_orderkey").alias("cited"))
    evidence = items.filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("claim_id"))
    return anchors(sections, evidence, ["team", "market"])


@query(
    """SELECT unnest(['github_kept', 'github_rewritten', 'github_cleared', 'twitter_rewritten']) AS metric, unnest([count(*) FILTER (WHERE c_custkey % 3 = 0), count(*) FILTER (WHERE c_custkey % 3 = 1), count(*) FILTER (WHERE c_custkey % 3 = 2), count(*)]) AS n FROM customer
    UNION ALL SELECT 'stored', count(*) + count(*) FILTER (WHERE c_custkey % 3 < 2) FROM customer"""
)
def identity_repair_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gated identity repair does to a clean snapshot, and how many rows it stores."""
    import uuid

    from ..operators.graph import shared_folder

    n = F.col("c_custkey")
    github = F.when(n % 3 == 0, F.concat(F.lit("dev"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("https://github.com/Dev"), n.cast("string"))).otherwise("https://github.com/orgs/a")
    rows = D.table(spark, sf_dir, "customer").select(n.alias("founder_id"), F.explode(F.create_map(F.lit("github"), github, F.lit("twitter"), F.concat(F.lit("@Tw"), n.cast("string")))).alias("kind", "value"))
    path = f"{shared_folder(spark)}/identities-{uuid.uuid4().hex}"
    counts = R.repaired_identities(rows.withColumn("identity_id", F.col("founder_id")), path)
    stored = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit("stored").alias("metric"), "n")
    return spark.createDataFrame([(k, v) for k, v in counts.items() if v], "metric string, n long").unionByName(stored)
