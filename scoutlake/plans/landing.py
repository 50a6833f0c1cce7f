"""Queries over landed payloads and streams: files written from the driver's tables, read as every channel's reader does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import warm as W
from ..operators.graph import shared_folder
from ..registry import query
from ..sources import domain as D
from ..sources import fetchers as X
from ..sources import readers as R
from ..streaming import signals as S

_STOP = ["the", "a", "of", "and"]


def _landed(rows: DataFrame, kind: str = "json") -> str:
    """The rows written to the shared folder as a connector lands them."""
    path = f"{shared_folder(rows.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows.write.format(kind).save(path)
    return path


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'https://e.test/' || doc_id ELSE title END AS title, url, substr(CASE WHEN doc_id % 3 = 0 OR text = '' THEN 'excerpt' ELSE text END, 1, 3500) AS content FROM (SELECT doc_id, coalesce(text, '') AS text, 'Title ' || doc_id AS title, 'https://e.test/' || doc_id AS url FROM documents) WHERE doc_id % 5 <> 0"""
)
def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web results: raw content before the excerpt, rows without a valid URL dropped, missing titles from the URL."""
    k = F.col("doc_id")
    url = F.concat(F.lit("https://e.test/"), k.cast("string"))
    rows = D.table(spark, sf_dir, "documents").select(F.lit("web").alias("channel"), F.when(k % 4 != 0, F.concat(F.lit("Title "), k.cast("string"))).otherwise(" ").alias("title"), F.when(k % 5 == 0, F.lit("ftp:nowhere")).otherwise(F.concat(F.lit(" "), url)).alias("url"), F.lit("excerpt").alias("content"), F.when(k % 3 != 0, F.coalesce("text", F.lit(""))).alias("raw_content"))
    hits = R.reader("none such")(spark, _landed(rows))
    return hits.select(F.substring_index("url", "/", -1).cast("long").alias("doc_id"), "title", "url", "content")


@query(
    """SELECT p_partkey, 'owner/' || p_partkey AS title, 'text ' || p_partkey || chr(10) || 'owner: o' || p_size || ' https://github.com/o' || p_size || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'language: ' || lower(p_type) ELSE '' END || chr(10) || 'stars: ' || p_size || chr(10) || 'topics: a, ' || p_size || chr(10) || 'pushed: ' || pushed AS content
    FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '2001-01-01T00:00:00Z' ELSE '2001-07-0' || (1 + p_partkey % 9) || 'T00:00:00Z' END AS pushed FROM part) WHERE p_partkey % 3 <> 0"""
)
def repository_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories pushed within 120 days, with their owner's page spelled out."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pushed = F.when(k % 3 == 0, "2001-01-01T00:00:00Z").otherwise(F.concat(F.lit("2001-07-0"), (1 + k % 9).cast("string"), F.lit("T00:00:00Z")))
    owner = F.struct(F.concat(F.lit("o"), size).alias("login"), F.concat(F.lit("https://github.com/o"), size).alias("html_url"))
    rows = D.table(spark, sf_dir, "part").select(F.lit("code").alias("channel"), F.concat(F.lit("owner/"), k.cast("string")).alias("full_name"), F.concat(F.lit("https://github.com/owner/"), k.cast("string")).alias("html_url"), F.concat(F.lit("text "), k.cast("string")).alias("description"), F.when(k % 2 == 0, F.lower("p_type")).alias("language"), F.col("p_size").cast("long").alias("stargazers_count"), F.array(F.lit("a"), size).alias("topics"), pushed.alias("pushed_at"), owner.alias("owner"))
    hits = R.repositories(spark, _landed(rows), as_of=D.AS_OF)
    return hits.select(F.substring_index("url", "/", -1).cast("long").alias("p_partkey"), "title", "content")


@query("SELECT s_suppkey, 'Paper ' || s_suppkey AS title, 'authors: Ann ' || s_suppkey || ', Bo Li' || chr(10) || 'published: 2001-01-0' || (1 + s_suppkey % 9) || 'T00:00:00Z' || chr(10) || 'about ' || s_suppkey AS content FROM supplier")
def paper_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feeds: an entry a paper, authors in order, white space squeezed."""
    k = F.col("s_suppkey").cast("string")
    names = F.array(F.struct(F.concat(F.lit("Ann  "), k).alias("name")), F.struct(F.lit(" Bo Li ").alias("name")))
    rows = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("http://e.test/abs/"), k).alias("id"), F.concat(F.lit("Paper\n  "), k).alias("title"), F.concat(F.lit(" about  "), k).alias("summary"), F.concat(F.lit("2001-01-0"), (1 + F.col("s_suppkey") % 9).cast("string"), F.lit("T00:00:00Z")).alias("published"), names.alias("author"))
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    rows.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    hits = R.reader("arxiv")(spark, path)
    return hits.select(F.substring_index("url", "/", -1).cast("long").alias("s_suppkey"), "title", "content")


@query(
    """SELECT c_custkey, 'https://news.ycombinator.com/item?id=' || c_custkey AS url, 'by ' || lower(c_mktsegment) || chr(10) || 'points: ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'https://e.test/' || c_custkey ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'see https://e.test/a & more' ELSE '' END AS content FROM customer"""
)
def story_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories: optional URL and text, escaped HTML as plain text that keeps link targets."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.lit("see &lt;a href=&quot;https:&#x2F;&#x2F;e.test&#x2F;a&quot; rel=x&gt;here&lt;/a&gt; &amp; &lt;i&gt;more&lt;/i&gt;"))
    rows = D.table(spark, sf_dir, "customer").select(F.lit("hn").alias("channel"), k.cast("string").alias("objectID"), F.lit("t").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("https://e.test/"), k.cast("string"))).alias("url"), F.lower("c_mktsegment").alias("author"), F.col("c_nationkey").cast("long").alias("points"), text.alias("story_text"))
    hits = R.reader("hn")(spark, _landed(rows))
    return hits.select(F.substring_index("url", "=", -1).cast("long").alias("c_custkey"), "url", "content")


@query("SELECT event_id, CAST(coalesce(CASE WHEN event_id % 2 = 0 THEN 0.75 END, 0.5) AS DOUBLE) AS source_reliability, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE 'r' || event_id END AS raw FROM events")
def signal_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered signals under the contract's schema, with its defaults."""
    k = F.col("event_id")
    rows = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), k.cast("string").alias("external_id"), F.when(k % 2 == 0, 0.75).alias("source_reliability"), F.when(k % 3 != 0, F.concat(F.lit("r"), k.cast("string"))).alias("raw"))
    return R.envelopes(spark, _landed(rows)).select(F.col("external_id").cast("long").alias("event_id"), "source_reliability", "raw")


@query("SELECT conv_id, turn, conv_id || '#' || turn AS external_id, 'c page ' || turn AS title, coalesce(text, '') AS summary FROM conversations WHERE conv_id % 6 <> 0")
def deck_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per page of decks that have text at all."""
    pages = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("deck_id"), F.lit("c").alias("company"), F.col("turn").alias("page"), F.when(F.col("conv_id") % 6 == 0, " ").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    out = R.deck_pages(pages)
    return out.select(F.substring_index("external_id", "#", 1).cast("long").alias("conv_id"), F.substring_index("external_id", "#", -1).cast("long").alias("turn"), "external_id", "title", "summary")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'native' ELSE 'web' END AS channel FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 <> 0")
def hits_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose own source gave nothing take the web's hits."""
    part = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"))
    out = R.with_fallback(part.filter("query_id % 4 = 0").withColumn("channel", F.lit("native")), part.filter("query_id % 3 <> 0").withColumn("channel", F.lit("web")))
    return out.select(F.col("query_id").alias("p_partkey"), "channel")


@query(r"SELECT item_id, list_aggregate(list_slice(words, 1, 5), 'string_agg', ' ') AS words FROM (SELECT item_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS words FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#.\-]*[a-z0-9+#]|[a-z0-9]'), lambda x: x NOT IN ('the', 'a', 'of', 'and')) AS w FROM benchmark))")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different words of each query that are no stop words."""
    return D.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(I.keywords(F.col("text"), _STOP, 5), " ").alias("words"))


def _stream(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """The events as a stream of landed files, each file `copies` times."""
    s = D.signals(spark, sf_dir).select("source", "external_id", "signal_type", "signal_id", "founder_id", "ingested_at")
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(copies):
        s.repartitionByRange(4, "ingested_at", "signal_id").write.mode("append").parquet(path)
    return spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 3).parquet(path)


@query(D.with_views("signal", sql="SELECT source, external_id, signal_type FROM signal"))
def polled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that delivers everything twice, polled to its end: every key is stored once."""
    folder = f"{shared_folder(spark)}/polled-{uuid.uuid4().hex}"
    stream = _stream(spark, sf_dir, 2).select("source", "external_id", "signal_type", "signal_id")
    S.run_once(stream, S.append_new(f"{folder}/table", ["source", "external_id"], ["signal_id"], I.upsert_new), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("source", "external_id", "signal_type")


@query(D.with_views("signal", sql="SELECT founder_id, count(*) AS n_signals, count(DISTINCT signal_id) AS n_distinct FROM signal GROUP BY founder_id"))
def incremental_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims built as signals arrive, by a cursor per founder: the same signals as one pass over all, each once."""
    folder = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    s = D.signals(spark, sf_dir).select("founder_id", "signal_id", "ingested_at")
    for k in range(3):  # three deliveries in order of time, the later ones with what came before once more
        edge = s.agg(F.expr(f"percentile_approx(unix_micros(ingested_at), {(k + 1) / 3})").alias("p")).first()["p"]
        part = s.filter(F.unix_micros("ingested_at") <= edge)
        stream_path = f"{folder}/landed"
        part.write.mode("append").parquet(stream_path)
        stream = spark.readStream.schema(s.schema).parquet(stream_path)
        write = S.claims_of_new_signals(f"{folder}/cursors", lambda rows: rows.select("founder_id", "signal_id", "path"), f"{folder}/table")
        S.run_once(stream, write, f"{folder}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{folder}/table")
    return done.groupBy("founder_id").agg(F.count("*").alias("n_signals"), F.count_distinct("signal_id").alias("n_distinct"))


_BATCH_EDGES = ("2024-01-11", "2024-01-21")
_CATEGORY = ("research", "traction", "employment", "education", "media", "affiliation")


def _extract(fresh: DataFrame) -> DataFrame:
    """A claim from each fresh signal: some out of the taxonomy or blank, some keyed, some cited against by the signal before."""
    k = F.col("signal_id")
    category = F.when(k % 23 == 0, "gossip").otherwise(F.element_at(F.array(*map(F.lit, _CATEGORY)), (k % 6 + 1).cast("int")))
    return fresh.select(
        "founder_id", k.alias("claim_no"), F.when(k % 19 == 0, "  ").otherwise(F.concat(F.lit("claim "), k.cast("string"))).alias("statement"), category.alias("category"), F.lit(0.5).alias("impact"),
        F.when(k % 4 != 0, F.concat(F.lit("k"), (k % 7).cast("string"))).alias("dedup_key"), F.array("pos").alias("supporting"), F.when(k % 5 == 0, F.array(F.col("pos") - 1)).alias("refuting"),
    )


def _warm_folder(spark: SparkSession, sf_dir: str) -> str:
    """All signals in three deliveries by time, each with the one before it once more; returns the folder of the state."""
    folder = f"{shared_folder(spark)}/warm-{uuid.uuid4().hex}"
    s = D.signals(spark, sf_dir).select("founder_id", "signal_id", "source", "ingested_at", "occurred_at", (0.3 + (F.col("signal_id") % 5) / 10).alias("weight"))
    part = F.lit(0)
    for edge in _BATCH_EDGES:
        part = part + (F.col("ingested_at") >= F.lit(edge).cast("timestamp")).cast("int")
    for k in range(len(_BATCH_EDGES) + 1):
        s.filter(part.between(k - 1, k)).write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{folder}/landed")
        S.run_once(stream, W.writer(f"{folder}/table", _extract, D.as_of()), f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/table"


_WARM = """s AS (SELECT founder_id, signal_id, ingested_at, round(0.3 + (signal_id % 5) / 10.0, 1) AS weight, CASE WHEN ingested_at < TIMESTAMP '2024-01-11' THEN 0 WHEN ingested_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch FROM signal),
    n AS (SELECT *, lag(signal_id) OVER w AS before, lag(weight) OVER w AS weight_before FROM s WINDOW w AS (PARTITION BY founder_id, batch ORDER BY ingested_at, signal_id)),
    v AS (SELECT *, CASE WHEN signal_id % 4 <> 0 THEN 'k' || (signal_id % 7) END AS k FROM n WHERE signal_id % 23 <> 0 AND signal_id % 19 <> 0),
    o AS (SELECT founder_id, k, min((batch, signal_id)) AS first FROM v WHERE k IS NOT NULL GROUP BY founder_id, k),
    r AS (SELECT v.*, first, v.k IS NOT NULL AND v.batch > first[1] AS attach FROM v LEFT JOIN o ON v.founder_id = o.founder_id AND v.k = o.k),"""


@query(
    D.with_views(
        "signal",
        sql=f""", {_WARM}
        e AS (SELECT CASE WHEN attach THEN first[2] ELSE signal_id END AS claim_id, signal_id, 'supports' AS stance, weight FROM r UNION ALL SELECT signal_id, before, 'refutes', weight_before FROM r WHERE NOT attach AND signal_id % 5 = 0 AND before IS NOT NULL),
        t AS (SELECT claim_id, count(*) AS n_evidence, 1 - coalesce(product(1 - weight) FILTER (WHERE stance = 'supports'), 1) AS sup, 1 - coalesce(product(1 - weight) FILTER (WHERE stance = 'refutes'), 1) AS ref, coalesce(max(weight) FILTER (WHERE stance = 'refutes'), 0) AS strongest FROM e GROUP BY claim_id)
        SELECT founder_id, claim_id, batch, CASE claim_id % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'traction' WHEN 2 THEN 'employment' WHEN 3 THEN 'education' WHEN 4 THEN 'media' ELSE 'affiliation' END AS category, CASE WHEN first[2] = r.signal_id THEN k END AS dedup_key, n_evidence,
        floor(sup * (1 - ref) * 10000 + 0.500001) / 10000 AS trust, CASE WHEN strongest >= 0.4 THEN 'contradicted' WHEN floor(sup * (1 - ref) * 10000 + 0.500001) / 10000 >= 0.7 THEN 'verified' ELSE 'unverified' END AS status FROM r JOIN t ON claim_id = signal_id WHERE NOT attach""",
    )
)
def streamed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims minted, and joined by later evidence, as signals stream in, with trust as the last batch leaves it."""
    c = W.claims(spark, _warm_folder(spark, sf_dir))
    return c.select("founder_id", "claim_id", "batch", "category", "dedup_key", (F.col("corroboration_n") + F.col("refutation_n")).alias("n_evidence"), "trust", "status")


@query(
    D.with_views(
        "signal",
        sql=f""", {_WARM}
        a AS (SELECT founder_id, batch, count(*) AS n_signals FROM s GROUP BY founder_id, batch), w AS (SELECT founder_id, batch, count(*) FILTER (WHERE NOT attach) AS minted, count(*) FILTER (WHERE attach) AS attached FROM r GROUP BY founder_id, batch),
        f AS (SELECT founder_id, min(batch) AS b FROM r GROUP BY founder_id)
        SELECT a.founder_id, a.batch, CASE WHEN a.batch > b THEN 'warm' ELSE 'cold' END AS mode, n_signals, coalesce(minted, 0) AS minted, coalesce(attached, 0) AS attached FROM a LEFT JOIN w USING (founder_id, batch) LEFT JOIN f ON a.founder_id = f.founder_id""",
    )
)
def streamed_claim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch of the same stream did for each founder it touched."""
    return W.runs(spark, _warm_folder(spark, sf_dir)).select("founder_id", "batch", "mode", "n_signals", "minted", "attached")


@query(D.with_views("signal", sql="SELECT source, external_id FROM signal"))
def deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that delivers everything twice, kept once by state per key that a timer lets go."""
    folder = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    out = S.deduplicated(_stream(spark, sf_dir, 2), within="60 days").select("source", "external_id")
    out.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/table")


@query(D.with_views("signal", sql="SELECT source, strftime(date_trunc('day', ingested_at), '%Y-%m-%d') AS day, count(*) AS n FROM signal GROUP BY 1, 2"))
def signals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each source and day, counted as they stream in; the last update of a window counts."""
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    counts = S.counts_by_window(_stream(spark, sf_dir, 1), size="1 day", late="60 days")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}")
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema("window struct<start: timestamp, end: timestamp>, source string, n long, batch long").parquet(f"{folder}/table")
    return updates.groupBy("source", F.date_format("window.start", "yyyy-MM-dd").alias("day")).agg(F.max_by("n", "batch").alias("n"))


def _titled(query: str, channel: str):
    """A fetcher as a user writes it: as many hits as the query's length leaves by three, none for some."""
    if len(query) % 7 == 0:
        raise LookupError("refused")
    for n in range(len(query) % 3):
        yield {"title": query[:20], "url": f"https://e.test/{channel}/{n}", "content": "titled"}


def _plain(query: str, channel: str):
    return [{"title": channel, "url": "https://e.test/plain", "content": query[-5:]}]


@query(
    """WITH q AS (SELECT doc_id, text, length(text) AS n, 'c' || (doc_id % 3) AS channel, doc_id % 2 = 0 AS titled FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, channel, CAST(pos AS INT) AS pos, substr(text, 1, 20) AS title, 'https://e.test/' || channel || '/' || pos AS url, 'titled' AS content, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(range(n % 3)) AS pos FROM q WHERE titled AND n % 7 <> 0)
    UNION ALL SELECT doc_id, channel, NULL, NULL, NULL, NULL, 'LookupError: refused' FROM q WHERE titled AND n % 7 = 0
    UNION ALL SELECT doc_id, channel, 0, channel, 'https://e.test/plain', substr(text, greatest(n - 4, 1), 5), NULL FROM q WHERE NOT titled"""
)
def fetched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a query to the fetcher it names, half of them to one that nobody has written: the default answers."""
    k = F.col("doc_id")
    queries = D.table(spark, sf_dir, "documents").select(k.alias("query_no"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("channel"), F.when(k % 2 == 0, "titled").otherwise("unwritten").alias("fetcher"), F.col("text").alias("query"))
    return X.fetched(queries, {"titled": _titled, "plain": _plain}, "plain").withColumnRenamed("query_no", "doc_id")
