"""The sourcing domain's tables as views over the driver's tables. VIEWS holds the same views for SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of all jobs over these views.
AS_OF = "2001-08-01 00:00:00"

CATEGORY_OF_PRIORITY = {"1-URGENT": "research", "2-HIGH": "traction", "3-MEDIUM": "employment", "4-NOT SPECIFIED": "media", "5-LOW": "education"}
STATUS_OF_ORDER = {"O": "screening", "F": "diligence", "P": "decided"}


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, mapping: dict[str, str], other: str):
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)


def founders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("founder_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("occupation"), F.col("n_name").alias("city"),
        F.col("n_regionkey").alias("country"), F.when(F.col("c_custkey") % 4 == 0, "watchlist").when(F.col("c_custkey") % 4 == 1, "active").otherwise("discovered").alias("status"),
        F.when(F.col("c_custkey") % 11 != 0, F.round(F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000, 4)).alias("discovery_confidence"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("founder_id"), _case(F.col("o_orderpriority"), CATEGORY_OF_PRIORITY, "affiliation").alias("category"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("impact"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate").cast("timestamp")).alias("occurred_at"),
    )


def raw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence as extractors deliver it: one signal may support a claim several times."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("signal_id"), F.when(F.col("l_returnflag") == "R", "refutes").otherwise("supports").alias("stance"),
        (F.col("l_quantity") / 50).alias("reliability"), (1 - F.col("l_tax")).alias("confidence"), F.when(F.col("l_discount") > 0, 1 - F.col("l_discount")).alias("relevance"), F.concat(F.lit("src"), (F.col("l_suppkey") % 5).cast("string")).alias("source"),
    )


def score_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("founder_id"), F.round(F.col("o_totalprice") / 10000, 0).alias("score"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("point_id"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = _case(F.col("event_type"), {"click": "github", "view": "arxiv", "purchase": "crunchbase", "signup": "hn"}, "web")
    return e.select(
        F.col("event_id").alias("signal_id"), source.alias("source"), F.col("event_id").cast("string").alias("external_id"), F.col("event_type").alias("signal_type"), F.col("user_id").alias("founder_id"), F.col("ts").cast("timestamp").alias("ingested_at"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("occurred_at"), F.col("value"), F.col("props").alias("raw"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deal for each order of a high price: its customer is the founder, its month the intake."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(
        F.col("o_orderkey").alias("opportunity_id"), F.col("o_custkey").alias("founder_id"), (F.col("o_orderkey") % 97).alias("company_id"), _case(F.col("o_orderstatus"), STATUS_OF_ORDER, "screening").alias("status"),
        F.lower("o_orderpriority").alias("sector"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp") + F.expr("interval 9 days")).alias("decided_at"), F.col("o_totalprice").alias("size"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People as sources mention them: a name, an account handle that several may share, a company and a city."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("display_name"), F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("-"), F.col("p_size").cast("string")).alias("github"), F.lower("p_type").alias("company"), (F.col("p_size") % 10).cast("string").alias("city"),
    )


#: Each view in SQL that Spark's rivals can run too, for oracles.
VIEWS = {
    "founder": """SELECT c_custkey AS founder_id, c_name AS display_name, c_mktsegment AS occupation, n_name AS city, n_regionkey AS country,
        CASE c_custkey % 4 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'active' ELSE 'discovered' END AS status,
        CASE WHEN c_custkey % 11 <> 0 THEN round(greatest(0.0, c_acctbal) / 10000, 4) END AS discovery_confidence
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "claim": """SELECT o_orderkey AS claim_id, o_custkey AS founder_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'research' WHEN '2-HIGH' THEN 'traction'
        WHEN '3-MEDIUM' THEN 'employment' WHEN '4-NOT SPECIFIED' THEN 'media' WHEN '5-LOW' THEN 'education' ELSE 'affiliation' END AS category,
        least(1.0, o_totalprice / 500000) AS impact, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS occurred_at FROM orders""",
    "raw_evidence": """SELECT l_orderkey AS claim_id, l_orderkey * 10 + l_linenumber AS signal_id, CASE WHEN l_returnflag = 'R' THEN 'refutes' ELSE 'supports' END AS stance,
        l_quantity / 50 AS reliability, 1 - l_tax AS confidence, CASE WHEN l_discount > 0 THEN 1 - l_discount END AS relevance, 'src' || (l_suppkey % 5) AS source FROM lineitem""",
    "evidence": """SELECT claim_id, signal_id, CASE WHEN bool_or(stance = 'refutes') THEN 'refutes' ELSE 'supports' END AS stance, max(weight) AS weight, min(source) AS source
        FROM (SELECT *, greatest(0.0, least(1.0, coalesce(reliability, 0.4) * coalesce(confidence, 0.7) * coalesce(relevance, 0.8))) AS weight FROM raw_evidence) GROUP BY claim_id, signal_id""",
    "trust": """SELECT claim_id, floor((support * (1 - refute)) * 10000 + 0.500001) / 10000 AS trust, floor((support) * 10000 + 0.500001) / 10000 AS support, floor((refute) * 10000 + 0.500001) / 10000 AS refute, corroboration_n, refutation_n, sources, external_verified,
        CASE WHEN strongest >= 0.4 THEN 'contradicted' WHEN floor((support * (1 - refute)) * 10000 + 0.500001) / 10000 >= 0.7 THEN 'verified' ELSE 'unverified' END AS status FROM (
        SELECT claim_id, 1 - coalesce(product(1 - weight) FILTER (WHERE stance = 'supports'), 1) AS support, 1 - coalesce(product(1 - weight) FILTER (WHERE stance = 'refutes'), 1) AS refute,
        count(*) FILTER (WHERE stance = 'supports') AS corroboration_n, count(*) FILTER (WHERE stance = 'refutes') AS refutation_n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
        coalesce(bool_or(weight >= 0.8) FILTER (WHERE stance = 'supports'), false) AS external_verified, coalesce(max(weight) FILTER (WHERE stance = 'refutes'), 0) AS strongest FROM evidence GROUP BY claim_id)""",
    "contribution": """SELECT c.founder_id, c.claim_id, c.category, c.occurred_at, coalesce(t.status, 'unverified') AS status,
        coalesce(t.trust, 0) * coalesce(c.impact, 0) * CASE c.category WHEN 'research' THEN 1.0 WHEN 'traction' THEN 1.0 WHEN 'employment' THEN 0.6 WHEN 'media' THEN 0.4 WHEN 'education' THEN 0.5 WHEN 'affiliation' THEN 0.6 ELSE 0.5 END
        * CASE WHEN c.occurred_at IS NULL THEN 0.6 ELSE pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(c.occurred_at)) / 86400000000.0) / 540.0) END AS x,
        coalesce(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(c.occurred_at)) / 86400000000.0) <= 180, false) AS recent
        FROM claim c LEFT JOIN trust t USING (claim_id)""",
    "score": """SELECT founder_id, round(100 * (1 - exp(-sum(x) / 3)), 1) AS founder_score, round(100 * (1 - exp(-coalesce(sum(x) FILTER (WHERE category IN ('research')), 0) / 3)), 1) AS tech,
        round(100 * (1 - exp(-coalesce(sum(x) FILTER (WHERE category IN ('traction')), 0) / 3)), 1) AS execution,
        round(100 * (1 - exp(-coalesce(sum(x) FILTER (WHERE category IN ('employment', 'education', 'affiliation')), 0) / 3)), 1) AS pedigree,
        round(100 * (1 - exp(-coalesce(sum(x) FILTER (WHERE category = 'media'), 0) / 3)), 1) AS influence,
        CASE WHEN sum(x) > 0 THEN round(coalesce(sum(x) FILTER (WHERE recent), 0) / sum(x), 3) ELSE 0 END AS momentum,
        count(*) AS n_claims, count(*) FILTER (WHERE status = 'verified') AS n_verified FROM contribution GROUP BY founder_id""",
    "score_point": "SELECT o_custkey AS founder_id, round(o_totalprice / 10000, 0) AS score, o_orderdate AS created_at, o_orderkey AS point_id FROM orders",
    "signal": """SELECT event_id AS signal_id, CASE event_type WHEN 'click' THEN 'github' WHEN 'view' THEN 'arxiv' WHEN 'purchase' THEN 'crunchbase' WHEN 'signup' THEN 'hn' ELSE 'web' END AS source,
        CAST(event_id AS VARCHAR) AS external_id, event_type AS signal_type, user_id AS founder_id, ts AS ingested_at, CASE WHEN event_id % 5 <> 0 THEN ts END AS occurred_at, value, props AS raw FROM events""",
    "opportunity": """SELECT o_orderkey AS opportunity_id, o_custkey AS founder_id, o_orderkey % 97 AS company_id, CASE o_orderstatus WHEN 'O' THEN 'screening' WHEN 'F' THEN 'diligence' WHEN 'P' THEN 'decided' ELSE 'screening' END AS status,
        lower(o_orderpriority) AS sector, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 9 DAY END AS decided_at, o_totalprice AS size FROM orders WHERE o_totalprice > 300000""",
    "mention": """SELECT p_partkey AS mention_id, p_name AS display_name, lower(replace(p_brand, '#', '-')) || '-' || p_size AS github, lower(p_type) AS company, CAST(p_size % 10 AS VARCHAR) AS city FROM part""",
}
_NEEDS = {"evidence": ["raw_evidence"], "trust": ["evidence"], "contribution": ["claim", "trust"], "score": ["contribution"]}


def with_views(*names: str, sql: str) -> str:
    """`sql` with the named views, and those they need, put before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + sql


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view in SQL over the driver's tables."""
    used = [t for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split() if f"FROM {t}" in text or f"JOIN {t}" in text]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text.replace("VARCHAR", "STRING"), **{t: table(spark, sf_dir, t) for t in used})
