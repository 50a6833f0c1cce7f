"""Queries over the key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..registry import query
from ..sources import domain as D

_LEGAL = ", ".join(f"'{x}'" for x in K.LEGAL_FORMS)
_SUFFIXED = """SELECT s_suppkey, s_name || CASE s_suppkey % 5 WHEN 0 THEN ' GmbH' WHEN 1 THEN ', Inc.' WHEN 2 THEN '  LTD' WHEN 3 THEN ' & Co. KG' ELSE '' END AS name,
    CASE s_suppkey % 3 WHEN 0 THEN 'https://www.S' || s_suppkey || '.example.com/about' WHEN 1 THEN 's' || s_suppkey || '.example.com.' END AS website FROM supplier"""


def suffixed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources write companies: with legal forms and spelled-out sites."""
    return spark.sql(_SUFFIXED.replace("FROM supplier", "FROM {supplier}"), supplier=D.table(spark, sf_dir, "supplier"))


@query(
    f"""SELECT s_suppkey, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE words END, ' ') AS name_key, regexp_replace(regexp_replace(lower(nullif(regexp_extract(full_url, '^[^:/?#]*://([^/?#]*)', 1), '')), '^www\\.', ''), '\\.+$', '') AS domain FROM (
    SELECT *, list_filter(words, lambda w: w NOT IN ({_LEGAL})) AS kept, CASE WHEN contains(website, '://') THEN website ELSE 'https://' || website END AS full_url FROM (SELECT *, regexp_extract_all(lower(name), '[a-z0-9]+') AS words FROM ({_SUFFIXED})))"""
)
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixed_companies(spark, sf_dir)
    return rows.select("s_suppkey", K.company_key(F.col("name")).alias("name_key"), K.domain_key(F.col("website")).alias("domain"))


@query("SELECT p_partkey, trim(p_name) AS person, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS compact, true AS is_person, split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', 2) AS last_name FROM part")
def person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name keys of mentions written with a title before them."""
    titled = D.table(spark, sf_dir, "part").withColumn("full", F.concat(F.lit("Prof. Dr. "), "p_name"))
    first, last = K.split_name(F.col("p_name"))
    return titled.select("p_partkey", K.person_name(F.col("full")).alias("person"), K.compact_name(F.col("full")).alias("compact"), K.is_person(F.col("full")).alias("is_person"), first.alias("first_name"), last.alias("last_name"))


_REFERENCES = """SELECT p_partkey, 'github' AS kind, CASE p_partkey % 4 WHEN 0 THEN 'https://github.com/User' || p_partkey || '/repo' WHEN 1 THEN '@User' || p_partkey WHEN 2 THEN 'https://github.com/orgs/x' ELSE 'https://gitlab.example.com/github.com/u' END AS raw FROM part"""


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'user' || p_partkey END AS value, CASE p_partkey % 4 WHEN 2 THEN 'reserved' WHEN 3 THEN 'wrong_host' END AS rejected,
    CASE WHEN p_partkey % 4 IN (0, 1) THEN 'https://github.com/user' || p_partkey END AS profile FROM ({_REFERENCES})"""
)
def profile_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account references in their spellings, and what each turned out to be."""
    rows = spark.sql(_REFERENCES.replace("FROM part", "FROM {part}"), part=D.table(spark, sf_dir, "part"))
    parsed = rows.withColumn("p", K.parse_identity(F.col("kind"), F.col("raw")))
    return parsed.select("p_partkey", "p.value", "p.rejected", K.profile_url(F.col("kind"), F.col("p.value")).alias("profile"))


@query("SELECT url, replace(regexp_replace(lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)), '^www\\.', ''), '', '') AS domain, count(*) AS n FROM pages GROUP BY url, domain")
def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "pages").groupBy("url", K.domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
