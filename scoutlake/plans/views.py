"""Queries for the read views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import views as V
from ..registry import query
from ..sources import domain as D


@query(D.with_views("signal", sql="SELECT signal_id, source, signal_type, external_id, value FROM signal ORDER BY ingested_at DESC, signal_id LIMIT 50"))
def signal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.feed(D.signals(spark, sf_dir)).select("signal_id", "source", "signal_type", "external_id", "value")


@query(D.with_views("signal", sql="""SELECT signal_id, source, raw FROM signal WHERE signal_type = 'purchase' AND (contains(lower(source), '"k": 4') OR contains(lower(raw), '"k": 4') OR contains(lower(external_id), '"k": 4') OR contains(lower(signal_type), '"k": 4')) ORDER BY ingested_at DESC, signal_id LIMIT 40"""))
def signal_feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.feed(D.signals(spark, sf_dir), "purchase", '"k": 4', 40).select("signal_id", "source", "raw")


@query(
    D.with_views(
        "founder", "signal",
        sql="""SELECT f.founder_id, display_name, city, discovery_confidence, coalesce(n, 0) AS signal_count, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_signal_at FROM founder f
        LEFT JOIN (SELECT founder_id, count(*) AS n, min(coalesce(occurred_at, ingested_at)) AS first_at FROM signal GROUP BY founder_id) USING (founder_id)""",
    )
)
def founder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.founder_list(D.founders(spark, sf_dir), D.signals(spark, sf_dir)).orderBy(F.desc_nulls_last("discovery_confidence"), "founder_id")
    return rows.select("founder_id", "display_name", "city", "discovery_confidence", "signal_count", F.date_format("first_signal_at", "yyyy-MM-dd HH:mm:ss").alias("first_signal_at"))


@query(
    D.with_views(
        "founder",
        sql=""", f AS (SELECT founder_id, display_name, occupation, discovery_confidence FROM founder WHERE status = 'active' AND contains(lower(occupation), 'mach')),
        r AS (SELECT *, row_number() OVER (ORDER BY discovery_confidence DESC NULLS LAST, founder_id) - 1 AS k, count(*) OVER () AS n FROM f) SELECT founder_id, display_name, occupation, discovery_confidence FROM r WHERE floor(k / 10) = least(2, ceil(n / 10) - 1)""",
    )
)
def founder_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of active founders in an occupation, by confidence."""
    rows = V.filtered_founders(D.founders(spark, sf_dir), status="active", needle="mach").filter(F.lower("occupation").contains("mach"))
    return V.sorted_page(rows, "discovery_confidence", True, 2).select("founder_id", "display_name", "occupation", "discovery_confidence")


@query(D.with_views("founder", sql="SELECT 'status' AS facet, status AS value, count(*) AS n FROM founder GROUP BY status UNION ALL SELECT 'city', city, count(*) FROM founder WHERE city IS NOT NULL GROUP BY city"))
def founder_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.facet_counts(D.founders(spark, sf_dir), "status", "city")


@query(D.with_views("founder", sql="SELECT founder_id, strftime(c, '%Y-%m-%d') AS last_checked_at FROM (SELECT founder_id, CASE WHEN founder_id % 50 <> 0 THEN DATE '2001-01-01' + CAST(founder_id % 90 AS INT) END AS c FROM founder) ORDER BY c ASC NULLS FIRST, founder_id LIMIT 25"))
def founders_to_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = F.when(F.col("founder_id") % 50 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (F.col("founder_id") % 90).cast("int"))).alias("last_checked_at")
    return V.stalest(D.founders(spark, sf_dir).select("founder_id", checked), 25).select("founder_id", F.date_format("last_checked_at", "yyyy-MM-dd").alias("last_checked_at"))


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = C.trust(C.fold_evidence(D.raw_evidence(spark, sf_dir))).select("claim_id", "trust", "status")
    return D.claims(spark, sf_dir).join(trust, "claim_id", "left")


@query(
    D.with_views(
        "claim", "trust",
        sql="""SELECT founder_id, string_agg(label, '; ' ORDER BY n) AS highlights, count(*) AS n_highlights FROM (SELECT founder_id, category || ' #' || claim_id AS label, row_number() OVER (PARTITION BY founder_id ORDER BY trust DESC NULLS LAST, claim_id) AS n
        FROM claim LEFT JOIN trust USING (claim_id)) WHERE n <= 6 GROUP BY founder_id""",
    )
)
def founder_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _trusted(spark, sf_dir).withColumn("label", F.concat_ws(" #", "category", F.col("claim_id").cast("string")))
    return V.highlights(claims)


@query(
    D.with_views(
        "founder", "signal", "claim", "trust",
        sql="""SELECT founder_id, display_name, coalesce(s.n, 0) AS n_signals, s.latest AS latest_signal, coalesce(c.n, 0) AS n_claims, c.best AS best_claim, c.best_trust AS best_trust FROM founder
        LEFT JOIN (SELECT founder_id, count(*) AS n, arg_max(signal_id, (ingested_at, -signal_id)) AS latest FROM signal GROUP BY founder_id) s USING (founder_id)
        LEFT JOIN (SELECT founder_id, max(m) AS n, max(claim_id) FILTER (WHERE k = 1) AS best, max(trust) FILTER (WHERE k = 1) AS best_trust FROM (SELECT *, row_number() OVER (PARTITION BY founder_id ORDER BY trust DESC NULLS LAST, claim_id) AS k, count(*) OVER (PARTITION BY founder_id) AS m
        FROM claim LEFT JOIN trust USING (claim_id)) GROUP BY founder_id) c USING (founder_id)""",
    )
)
def founder_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.founder_detail(D.founders(spark, sf_dir), D.signals(spark, sf_dir), _trusted(spark, sf_dir))
    return rows.select("founder_id", "display_name", "n_signals", "latest_signal", "n_claims", "best_claim", "best_trust")


@query(
    D.with_views(
        "founder", "signal", "opportunity",
        sql="""SELECT opportunity_id, display_name, status, sector, CAST(epoch(decided_at) - epoch(date_trunc('second', first_at)) AS BIGINT) AS latency_seconds FROM opportunity LEFT JOIN founder USING (founder_id)
        LEFT JOIN (SELECT founder_id, min(coalesce(occurred_at, ingested_at)) AS first_at FROM signal GROUP BY founder_id) USING (founder_id)""".replace("status, sector", "opportunity.status AS status, sector"),
    )
)
def opportunity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.opportunity_list(D.opportunities(spark, sf_dir), D.founders(spark, sf_dir), D.signals(spark, sf_dir)).orderBy(F.desc("created_at"), "opportunity_id")
    return rows.select("opportunity_id", "display_name", "status", "sector", "latency_seconds")


@query("SELECT conv_id, count(*) AS n_steps, min(turn) AS first_turn, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id")
def founder_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's steps in order."""
    steps = D.table(spark, sf_dir, "conversations")
    return steps.groupBy("conv_id").agg(F.count("*").alias("n_steps"), F.min("turn").alias("first_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("path"))


@query(D.with_views("signal", sql="SELECT founder_id, string_agg('[' || p || '] ' || source || ' ' || signal_type, chr(10) ORDER BY p) AS block, count(*) AS n_lines FROM (SELECT *, row_number() OVER (PARTITION BY founder_id ORDER BY ingested_at, signal_id) - 1 AS p FROM signal) WHERE p < 8 GROUP BY founder_id"))
def founder_signal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each founder's first eight signals as one numbered text block."""
    return V.indexed_blocks(D.signals(spark, sf_dir), "founder_id", ["ingested_at", "signal_id"], F.concat_ws(" ", "source", "signal_type"), 8)


@query("SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 12) AS INT) AS chunk FROM documents")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunked(D.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "source", "chunk")


@query(D.with_views("signal", sql="SELECT signal_id, source FROM signal WHERE ingested_at > TIMESTAMP '2024-01-29'"))
def signals_since_last_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.signals(spark, sf_dir)
    return V.unseen(rows, rows.filter(F.col("ingested_at") <= F.lit("2024-01-29").cast("timestamp")), "signal_id").select("signal_id", "source")


@query(D.with_views("signal", "founder", "opportunity", sql="SELECT 'signals' AS metric, count(*) AS n FROM signal UNION ALL SELECT 'founders', count(*) FROM founder UNION ALL SELECT 'opportunities', count(*) FROM opportunity UNION ALL SELECT 'channels', count(*) FROM region"))
def home_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [(n, d) for n, d in (("signals", D.signals(spark, sf_dir)), ("founders", D.founders(spark, sf_dir)), ("opportunities", D.opportunities(spark, sf_dir)), ("channels", D.table(spark, sf_dir, "region")))]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(D.with_views("opportunity", sql="SELECT opportunity_id, status, sector FROM opportunity WHERE contains(sector, 'urg') OR contains(status, 'urg') OR contains('venture ' || company_id, 'urg')"))
def matching_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals that a search in the list finds."""
    deals = D.opportunities(spark, sf_dir).withColumn("company_name", F.concat(F.lit("Venture "), F.col("company_id").cast("string")))
    return V.matching_deals(deals, " URG ").select("opportunity_id", "status", "sector")


@query(
    D.with_views(
        "claim", "trust", "score",
        sql=""", s AS (SELECT c_custkey AS founder_id FROM customer WHERE c_custkey < 40 UNION ALL SELECT -1), n AS (SELECT founder_id, count(*) AS n, bool_or(status = 'contradicted') AS c FROM claim LEFT JOIN trust USING (claim_id) GROUP BY founder_id),
        r AS (SELECT s.founder_id, c_custkey IS NOT NULL AS known, founder_score, coalesce(n, 0) AS n, coalesce(c, false) AS c FROM s LEFT JOIN customer ON c_custkey = s.founder_id LEFT JOIN score USING (founder_id) LEFT JOIN n USING (founder_id))
        SELECT 'all_known' AS property, bool_and(known) AS holds FROM r UNION ALL SELECT 'all_have_claims', bool_and(n > 0) FROM r UNION ALL SELECT 'has_cold_start', bool_or(n > 0 AND n < 5) FROM r UNION ALL SELECT 'has_bull', bool_or(coalesce(founder_score >= 40, false)) FROM r UNION ALL SELECT 'has_contradiction', bool_or(c) FROM r""",
    )
)
def subject_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed set of subjects against what is known: which of its properties still hold. One of them is made up."""
    from .claims import scores

    subjects = D.founders(spark, sf_dir).filter("founder_id < 40").select("founder_id")
    subjects = subjects.unionByName(subjects.limit(1).select(F.lit(-1).cast(subjects.schema["founder_id"].dataType).alias("founder_id")))
    founders = D.founders(spark, sf_dir).select("founder_id").join(scores(spark, sf_dir).select("founder_id", "founder_score"), "founder_id", "left")
    return V.subject_coverage(subjects, founders, _trusted(spark, sf_dir))[1]


@query(D.with_views("founder", sql="""SELECT asked, position, founder_id FROM (SELECT founder_id, row_number() OVER (ORDER BY discovery_confidence DESC NULLS LAST, founder_id) AS position, count(*) OVER () AS total FROM founder)
    JOIN (SELECT unnest([0, 3, 1000000000]) AS asked) ON (position - 1) // 10 = least(asked, (total - 1) // 10)"""))
def founder_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, fourth and last page of all founders, out of an index of pages."""
    import uuid

    from ..operators.graph import shared_folder
    from ..operators.ranks import read_page, write_pages

    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    write_pages(D.founders(spark, sf_dir).select("founder_id", "discovery_confidence"), [F.desc_nulls_last("discovery_confidence"), "founder_id"], path)
    index = spark.read.parquet(path)
    pages = [read_page(index, n).select(F.lit(n).alias("asked"), "position", "founder_id") for n in (0, 3, 10**9)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])
