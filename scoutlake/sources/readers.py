"""Landed payloads as hit tables, and the registry of readers by channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The row every connector delivers.
SIGNAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "signal_type", "external_id", "entity_hint", "url", "title", "summary")]
    + [T.StructField("occurred_at", T.TimestampType()), T.StructField("source_reliability", T.DoubleType()), T.StructField("raw", T.StringType())]
)
HIT = ("channel", "title", "url", "content")

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register(name: str) -> Callable[[Reader], Reader]:
    """Offer a reader (spark, path) -> hits under a channel's fetcher name."""

    def add(f: Reader) -> Reader:
        _READERS[name] = f
        return f

    return add


def reader(name: str | None) -> Reader:
    """The reader of that name, the web results' for unknown ones."""
    return _READERS.get(name or "", web_results)


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Signals as delivered, with the defaults of the contract filled in."""
    rows = spark.read.schema(SIGNAL).json(path)
    return rows.withColumn("source_reliability", F.coalesce("source_reliability", F.lit(0.5))).withColumn("raw", F.coalesce("raw", F.lit("{}")))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def plain_text(text: Column) -> Column:
    """Escaped HTML as text that keeps link targets."""
    out = F.coalesce(text, F.lit(""))
    for entity, letter in (("&#x2F;", "/"), ("&#x27;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    out = F.regexp_replace(out, r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', " $1 ")
    out = F.replace(F.regexp_replace(out, r"<[^>]+>", " "), F.lit("&amp;"), F.lit("&"))
    return _squeezed(out)


@register("web")
def web_results(spark: SparkSession, path: str) -> DataFrame:
    """Web results: raw content before the excerpt, at most 3,500 characters; rows without a valid http URL go."""
    rows = spark.read.schema("channel string, title string, url string, content string, raw_content string").json(path)
    url = F.trim("url")
    valid = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    content = F.substring(F.coalesce(F.nullif("raw_content", F.lit("")), "content", F.lit("")), 1, 3500)
    return rows.filter(valid).select("channel", F.coalesce(F.nullif(F.trim("title"), F.lit("")), url).alias("title"), url.alias("url"), content.alias("content"))


@register("github")
def repositories(spark: SparkSession, path: str, pushed_within_days: int = 120, as_of: str | None = None) -> DataFrame:
    """Repository search payloads pushed lately, with the owner's profile spelled out in the content."""
    schema = "channel string, full_name string, html_url string, description string, language string, stargazers_count long, topics array<string>, pushed_at string, owner struct<login: string, html_url: string>"
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    rows = spark.read.schema(schema).json(path).filter(F.try_to_timestamp("pushed_at") > now - F.make_dt_interval(F.lit(pushed_within_days)))
    parts = [
        F.col("description"), F.concat(F.lit("owner: "), F.col("owner.login"), F.lit(" "), F.col("owner.html_url")), F.concat(F.lit("language: "), F.col("language")),
        F.concat(F.lit("stars: "), F.col("stargazers_count").cast("string")), F.when(F.size("topics") > 0, F.concat(F.lit("topics: "), F.array_join("topics", ", "))), F.concat(F.lit("pushed: "), F.col("pushed_at")),
    ]
    return rows.select("channel", F.col("full_name").alias("title"), F.col("html_url").alias("url"), F.substring(F.concat_ws("\n", *parts), 1, 3500).alias("content"))


@register("arxiv")
def papers(spark: SparkSession, path: str) -> DataFrame:
    """Atom feeds: one hit per entry, authors in order, white space squeezed."""
    entry = "id string, title string, summary string, published string, author array<struct<name: string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(entry).load(path)
    authors = F.array_join(F.transform("author", lambda a: _squeezed(a["name"])), ", ")
    return rows.select(F.lit("arxiv").alias("channel"), _squeezed(F.col("title")).alias("title"), F.trim("id").alias("url"), F.concat_ws("\n", F.concat(F.lit("authors: "), authors), F.concat(F.lit("published: "), F.col("published")), _squeezed(F.col("summary"))).alias("content"))


@register("hn")
def stories(spark: SparkSession, path: str) -> DataFrame:
    """Story payloads; URL and text are optional."""
    rows = spark.read.schema("channel string, objectID string, title string, url string, author string, points long, story_text string, created_at string").json(path)
    parts = F.array_compact(F.array(F.concat(F.lit("by "), F.col("author")), F.concat(F.lit("points: "), F.col("points").cast("string")), F.nullif("url", F.lit("")), F.nullif(plain_text(F.col("story_text")), F.lit(""))))
    return rows.select("channel", "title", F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID")).alias("url"), F.array_join(parts, "\n").alias("content"))


def with_fallback(native: DataFrame, fallback: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The native source's hits, and the fallback's for queries that it gave none for."""
    return native.unionByName(fallback.join(native.select(query_id).distinct(), query_id, "left_anti"), allowMissingColumns=True)


def deck_pages(pages: DataFrame) -> DataFrame:
    """(deck_id, company, page, text) -> one signal per page of decks that have text at all."""
    readable = pages.groupBy("deck_id").agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("_some")).filter("_some").select("deck_id")
    rows = pages.join(readable, "deck_id", "left_semi")
    return rows.select(F.lit("deck").alias("source"), F.lit("deck_page").alias("signal_type"), F.concat_ws("#", "deck_id", F.col("page").cast("string")).alias("external_id"), F.concat_ws(" page ", "company", F.col("page").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("summary"), F.lit(0.4).alias("source_reliability"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's web pages as landed artifacts: URL, title element, whole html as summary, and its first 1,500 characters to show."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("summary"), F.substring("html", 1, 1500).alias("excerpt"))
