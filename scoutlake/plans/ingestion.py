"""Queries over signal ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import ingest as I
from ..registry import query
from ..sources import domain as D
from ..sources import readers as R

# a URL's key in SQL: scheme, www, fragment, trailing slash and tracking parameters dropped, parameters sorted
URL_KEY = r"""'https://' || regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '^www\.', '')
    || CASE WHEN rtrim(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/') END
    || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND split_part(kv, '=', 1) NOT IN
    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'ref_src'))), 'string_agg', '&'), ''), '')"""
_PAGES = r"SELECT page_id, CASE page_id % 7 WHEN 1 THEN replace(url, '.example.com', '.github.com') WHEN 2 THEN replace(url, '.example.com', '.arxiv.org') WHEN 3 THEN 'https://news.ycombinator.com/item?id=' || page_id WHEN 4 THEN replace(url, '.example.com', '.devpost.com') ELSE url END AS url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, html AS summary FROM pages"


@query(
    rf"""SELECT page_id, canonical_url, CASE WHEN words <> '' THEN sha256(words) END AS content_hash, source, CAST(CASE source WHEN 'arxiv' THEN 0.9 WHEN 'github' THEN 0.85 WHEN 'devpost' THEN 0.7 WHEN 'hn' THEN 0.5 WHEN 'youtube' THEN 0.5 ELSE 0.4 END AS DOUBLE) AS source_reliability FROM (
    SELECT page_id, canonical_url, words, CASE WHEN contains(canonical_url, 'arxiv.org') THEN 'arxiv' WHEN contains(canonical_url, 'github.com') THEN 'github' WHEN contains(canonical_url, 'news.ycombinator.com') THEN 'hn' WHEN contains(canonical_url, 'youtube.com') THEN 'youtube' WHEN contains(canonical_url, 'devpost.com') THEN 'devpost' ELSE 'web' END AS source FROM (
    SELECT page_id, {URL_KEY} AS canonical_url, trim(regexp_replace(lower(title || ' ' || coalesce(summary, '')), '[\s\x0B\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')) AS words FROM ({_PAGES})))"""
)
def page_signal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, k = R.landed(spark, sf_dir), F.col("page_id") % 7
    moved = lambda host: F.replace("url", F.lit(".example.com"), F.lit(host))
    url = F.when(k == 1, moved(".github.com")).when(k == 2, moved(".arxiv.org")).when(k == 3, F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("page_id").cast("string"))).when(k == 4, moved(".devpost.com")).otherwise(F.col("url"))
    return I.signal_keys(pages.withColumn("url", url)).select("page_id", "canonical_url", "content_hash", "source", "source_reliability")


def _respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, and every third one again under another spelling of its URL."""
    pages = R.landed(spark, sf_dir).select("page_id", "url")
    other = F.concat(F.replace(F.replace("url", F.lit("https://"), F.lit("http://www.")), F.lit("#top"), F.lit("")), F.lit("#again"))
    return pages.unionByName(pages.filter("page_id % 3 = 0").select((F.col("page_id") + 10_000_000).alias("page_id"), other.alias("url")))


_RESPELLED = "SELECT page_id, url FROM pages UNION ALL SELECT page_id + 10000000, replace(replace(url, 'https://', 'http://www.'), '#top', '') || '#again' FROM pages WHERE page_id % 3 = 0"


@query(f"SELECT canonical_url, min(page_id) AS survivor, count(*) AS n FROM (SELECT page_id, {URL_KEY} AS canonical_url FROM ({_RESPELLED})) GROUP BY canonical_url")
def signals_merged_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signal survives where several spellings of one page were ingested."""
    rows = _respelled(spark, sf_dir).select(F.col("page_id").alias("signal_id"), K.canonical_url(F.col("url")).alias("canonical_url"), F.lit("web").alias("source"), F.col("page_id").alias("ingested_at"))
    return I.merged_urls(rows)[0].select("canonical_url", F.col("signal_id").alias("survivor"), "n")


# Every spelling is attributed and cited; every other one that was met again belongs to a founder and a claim that its page lacks.
_EDGES = "SELECT page_id AS signal_id, page_id % 10000000 % 50 + CASE WHEN page_id >= 10000000 AND page_id % 2 = 0 THEN 1000 ELSE 0 END AS {key}, (page_id % 7) / 10.0 AS {value}, CASE WHEN (page_id + {shift}) % 3 = 0 THEN '{one}' ELSE '{other}' END AS {word} FROM ({rows})"
_ATTRIBUTED = {"key": "founder_id", "value": "confidence", "word": "method", "shift": 0, "one": "research", "other": "legacy"}
_CITED = {"key": "claim_id", "value": "weight", "word": "stance", "shift": 1, "one": "refutes", "other": "supports"}


@query(
    f"""WITH m AS (SELECT page_id AS signal_id, min(page_id) OVER (PARTITION BY url) AS survivor FROM (SELECT page_id, {URL_KEY} AS url FROM ({_RESPELLED}))),
    e AS (SELECT 'founder' AS part, founder_id AS key_id, signal_id, CAST(confidence AS DOUBLE) AS value, method AS word FROM ({_EDGES.format(rows=_RESPELLED, **_ATTRIBUTED)}) UNION ALL SELECT 'claim', claim_id, signal_id, CAST(weight AS DOUBLE), stance FROM ({_EDGES.format(rows=_RESPELLED, **_CITED)}))
    SELECT part, key_id, survivor AS signal_id, arg_min(value, e.signal_id) AS value, arg_min(word, e.signal_id) AS word FROM e JOIN m USING (signal_id) GROUP BY part, key_id, survivor"""
)
def edges_merged_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution and evidence on the surviving signals: what the survivor has stays, else the earliest merged edge, whole."""
    rows = _respelled(spark, sf_dir)
    rows.createOrReplaceTempView("respelled_pages")
    founders, claims = (spark.sql(_EDGES.format(rows="SELECT * FROM respelled_pages", **x)).withColumn(x["value"], F.col(x["value"]).cast("double")) for x in (_ATTRIBUTED, _CITED))
    signals = rows.select(F.col("page_id").alias("signal_id"), K.canonical_url(F.col("url")).alias("canonical_url"), F.lit("web").alias("source"), F.col("page_id").alias("ingested_at"))
    _, _, attributed, cited = I.merged_urls(signals, (founders, "founder_id"), (claims, "claim_id"))
    out = attributed.select(F.lit("founder").alias("part"), F.col("founder_id").alias("key_id"), "signal_id", F.col("confidence").alias("value"), F.col("method").alias("word"))
    return out.unionByName(cited.select(F.lit("claim").alias("part"), F.col("claim_id").alias("key_id"), "signal_id", F.col("weight").alias("value"), F.col("stance").alias("word")))


@query(D.with_views("signal", sql="SELECT source, external_id, signal_type FROM signal WHERE signal_id >= 5000"))
def signals_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed batch: rows known by (source, external_id) are not new."""
    rows = D.signals(spark, sf_dir).select("source", "external_id", "signal_type", "signal_id")
    batch = rows.filter("signal_id >= 2500").unionByName(rows.filter("signal_id >= 7000"))
    return I.upsert_new(batch, rows.filter("signal_id < 5000"), ["source", "external_id"], ["signal_id", "signal_type"]).select("source", "external_id", "signal_type")


@query(f"SELECT canonical_url, rank, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM (SELECT canonical_url, min(page_id) AS page_id, regexp_extract(canonical_url, '//([^/]*)', 1) AS host FROM (SELECT page_id, {URL_KEY} AS canonical_url FROM ({_RESPELLED})) GROUP BY canonical_url)) WHERE rank <= 10")
def hits_per_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each page, at most ten of each host."""
    rows = _respelled(spark, sf_dir).withColumn("canonical_url", K.canonical_url(F.col("url"))).withColumn("host", F.regexp_extract("canonical_url", "//([^/]*)", 1))
    return I.capped_per_group(rows.select("host", "canonical_url", "page_id"), "host", "canonical_url", ["page_id"], 10).select("canonical_url", "rank", "host")


@query(
    D.with_views(
        "signal",
        sql="""SELECT founder_id, signal_id, max(confidence) AS confidence, arg_max(method, (confidence, -fresh)) AS method FROM (SELECT founder_id, signal_id, 0.7 AS confidence, 'evidence' AS method, 0 AS fresh FROM signal WHERE signal_id % 2 = 0
        UNION ALL SELECT founder_id, signal_id, CASE WHEN signal_id % 3 = 0 THEN 0.9 ELSE 0.6 END, 'exact_key', 1 FROM signal) GROUP BY founder_id, signal_id""",
    )
)
def attribution_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a replay: confidence rises, never falls."""
    s = D.signals(spark, sf_dir)
    old = s.filter("signal_id % 2 = 0").select("founder_id", "signal_id", F.lit(0.7).alias("confidence"), F.lit("evidence").alias("method"), F.col("ingested_at").alias("attributed_at"))
    new = s.select("founder_id", "signal_id", F.when(F.col("signal_id") % 3 == 0, 0.9).otherwise(0.6).alias("confidence"), F.lit("exact_key").alias("method"), F.col("ingested_at").alias("attributed_at"))
    return I.attributed(old, new).drop("attributed_at")


@query("SELECT content_hash, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(' ' || text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1".replace("\\\\", "\\"))
def documents_by_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that are one by content."""
    docs = D.table(spark, sf_dir, "documents")
    return docs.select("doc_id", K.content_hash(F.lit(None).cast("string"), F.col("text")).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without any annotation: an anti-join."""
    return D.table(spark, sf_dir, "documents").select("doc_id").join(D.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT canonical_url, page_id, length(html) AS n_chars FROM (SELECT canonical_url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM (SELECT page_id, {URL_KEY} AS canonical_url, substr(html, 1, 1500) AS html FROM pages) GROUP BY canonical_url) ORDER BY page_id LIMIT 300")
def capped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hundred different pages of a run's hits, each with the excerpt that a reader gets."""
    hits = D.table(spark, sf_dir, "pages").select(F.lit(0).alias("query_no"), F.col("page_id").alias("pos"), F.lit("kpi").alias("subgoal"), "url", F.lit("t").alias("title"), F.col("html").alias("content"))
    return I.capped_hits(hits).select("canonical_url", F.col("pos").alias("page_id"), F.length("content").cast("long").alias("n_chars"))
