"""Queries over place resolution: a gazetteer from nations, regions as countries, customers as the people placed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as P
from ..operators import repairs as R
from ..registry import query
from ..sources import domain as D

# Of each nation: a namesake town, a large place of an alias that is another town's name, a place with an umlaut, and a city
# named like its region (a city-state) for two of the five regions.
_GAZETTEER = """SELECT n_nationkey * 10 AS geonameid, 'Stadt ' || (n_nationkey % 9) AS name, 'R' || n_regionkey AS countrycode, CAST((n_nationkey + 2) * (n_nationkey + 2) * (n_nationkey + 2) AS BIGINT) AS population, CAST(NULL AS VARCHAR) AS alias FROM nation
    UNION ALL SELECT n_nationkey * 10 + 1, 'Grossort ' || n_nationkey, 'R' || ((n_regionkey + 1) % 5), CAST((n_nationkey + 2) * (n_nationkey + 2) * (n_nationkey + 2) * CASE WHEN n_nationkey % 3 = 0 THEN 40 ELSE 2 END AS BIGINT), 'Stadt ' || ((n_nationkey + 4) % 12) FROM nation
    UNION ALL SELECT n_nationkey * 10 + 2, 'Munchhof ' || n_nationkey, 'R' || n_regionkey, CAST(5000 + n_nationkey AS BIGINT), 'Ort ' || n_nationkey FROM nation
    UNION ALL SELECT n_regionkey * 10 + 1003, n_name, 'R' || n_regionkey, CAST(90000 AS BIGINT), 'abc' FROM (SELECT r_regionkey AS n_regionkey, r_name AS n_name FROM region) r WHERE n_regionkey IN (1, 3)"""
_COUNTRIES = "SELECT r_name AS name, 'R' || r_regionkey AS code FROM region"
_MENTIONS = """SELECT c_custkey AS mention_id, CASE c_custkey % 13 WHEN 0 THEN 'STADT ' || (c_nationkey % 12) || ', x, ' || r_name WHEN 1 THEN 'Stadt-' || (c_nationkey % 12) WHEN 2 THEN ' Grossort ' || c_nationkey || ' ,' WHEN 3 THEN 'Muenchhof ' || c_nationkey
    WHEN 4 THEN r_name WHEN 5 THEN 'here / Remote' WHEN 6 THEN 'TUM, ' || r_name WHEN 7 THEN '  ' WHEN 8 THEN 'Munchhof ' || c_nationkey || ', ' || r_name WHEN 9 THEN 'Nirgendwo ' || (c_custkey % 3) WHEN 10 THEN NULL WHEN 11 THEN 'Ort ' || c_nationkey ELSE 'Stadt ' || (c_nationkey % 12) END AS raw,
    CASE WHEN c_custkey % 3 = 0 THEN 'R' || (c_custkey % 6) END AS country_hint FROM customer JOIN region ON r_regionkey = c_custkey % 5"""
_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def resolved_sql(mentions: str) -> str:
    """The resolver's rule as SQL: the gazetteer's owners of a name, weighed; spellings and hints tried in turn."""
    own, alias = _FOLD.format("name"), _FOLD.format("alias")
    return f"""g AS ({_GAZETTEER}), c AS ({_COUNTRIES}), m AS ({mentions}),
    k AS (SELECT key, geonameid, max(official) AS official FROM (SELECT {own} AS key, geonameid, 1 AS official FROM g UNION ALL SELECT {alias}, geonameid, 0 FROM g WHERE length({alias}) >= 4) GROUP BY key, geonameid),
    a AS (SELECT DISTINCT raw, country_hint AS hint FROM m), p AS (SELECT *, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM a WHERE raw IS NOT NULL AND trim(raw) <> ''),
    h AS (SELECT *, parts[1] AS head, CASE WHEN len(parts) > 1 THEN parts[2:] ELSE parts END AS later FROM p),
    st AS (SELECT raw, hint, arg_max(code, pos) AS stated FROM (SELECT raw, hint, unnest(later) AS part, unnest(range(len(later))) AS pos FROM h) JOIN c ON lower(name) = lower(part) GROUP BY raw, hint),
    w AS (SELECT h.*, stated, hc.code AS head_code, coalesce(stated, hc.code) AS country, {_FOLD.format("head")} AS own_key, lower(head) IN ('tum', 'null', 'none') AS no_city FROM h LEFT JOIN st ON st.raw = h.raw AND st.hint IS NOT DISTINCT FROM h.hint LEFT JOIN c hc ON lower(hc.name) = lower(head)),
    t AS (SELECT raw, hint, own_key, country, n, CASE WHEN n IN (1, 3) THEN own_key ELSE replace(replace(replace(own_key, 'ue', 'u'), 'oe', 'o'), 'ae', 'a') END AS key, CASE WHEN n <= 2 THEN coalesce(country, hint) END AS within FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE NOT no_city AND own_key <> '' AND (n <= 2 OR (country IS NULL AND hint IS NOT NULL))),
    d AS (SELECT DISTINCT key, within FROM t), f AS (SELECT d.key, d.within, k.official, g.* FROM d JOIN k ON k.key = d.key JOIN g USING (geonameid) WHERE d.within IS NULL OR d.within = g.countrycode),
    nr AS (SELECT *, countrycode IN ('R1', 'R2') AS eu, row_number() OVER (PARTITION BY key, within ORDER BY population DESC, geonameid) AS r, row_number() OVER (PARTITION BY key, within, countrycode IN ('R1', 'R2') ORDER BY population DESC, geonameid) AS re FROM f WHERE official = 1),
    nt AS (SELECT key, within, count(*) AS n, count(*) FILTER (WHERE eu) AS ne, max(geonameid) FILTER (WHERE r = 1) AS g1, max(population) FILTER (WHERE r = 1) AS p1, max(population) FILTER (WHERE r = 2) AS p2, max(geonameid) FILTER (WHERE eu AND re = 1) AS ge, max(population) FILTER (WHERE eu AND re = 1) AS e1, max(population) FILTER (WHERE eu AND re = 2) AS e2 FROM nr GROUP BY key, within),
    nw AS (SELECT key, within, CASE WHEN n = 1 OR p1 >= 10 * greatest(p2, 1) THEN g1 WHEN ne > 0 AND ne < n AND e1 >= 0.5 * p1 AND (ne = 1 OR e1 >= 10 * greatest(e2, 1)) THEN ge END AS gid, CASE WHEN n = 1 OR p1 >= 10 * greatest(p2, 1) THEN p1 ELSE e1 END AS pop, CASE WHEN n = 1 OR p1 >= 10 * greatest(p2, 1) THEN 'named' ELSE 'prior' END AS how FROM nt),
    pr AS (SELECT *, row_number() OVER (PARTITION BY key, within ORDER BY population DESC, geonameid) AS r FROM f), pw AS (SELECT key, within, count(*) AS n, max(geonameid) FILTER (WHERE r = 1) AS g1, max(population) FILTER (WHERE r = 1) AS p1, max(population) FILTER (WHERE r = 2) AS p2 FROM pr GROUP BY key, within),
    pool AS (SELECT key, within, n, g1 AS gid, p1 AS pop FROM pw WHERE n = 1 OR p1 >= 10 * greatest(p2, 1)),
    dec AS (SELECT d.key, d.within, CASE WHEN pool.gid IS NOT NULL AND nw.gid IS NOT NULL AND pool.pop >= 10 * greatest(nw.pop, 1) THEN pool.gid ELSE coalesce(nw.gid, pool.gid) END AS gid,
        CASE WHEN pool.gid IS NOT NULL AND nw.gid IS NOT NULL AND pool.pop >= 10 * greatest(nw.pop, 1) THEN 'inferred' WHEN nw.gid IS NOT NULL THEN nw.how WHEN pool.gid IS NOT NULL THEN CASE WHEN pool.n = 1 THEN 'alias' ELSE 'inferred' END
        WHEN pw.key IS NULL AND d.within IS NOT NULL AND d.key IN (SELECT key FROM k) THEN 'contradicted' ELSE 'unverified' END AS how
        FROM d LEFT JOIN nw ON nw.gid IS NOT NULL AND nw.key = d.key AND nw.within IS NOT DISTINCT FROM d.within LEFT JOIN pool ON pool.key = d.key AND pool.within IS NOT DISTINCT FROM d.within LEFT JOIN pw ON pw.key = d.key AND pw.within IS NOT DISTINCT FROM d.within),
    tr AS (SELECT t.raw, t.hint, t.n, gid, CASE WHEN how = 'named' THEN CASE WHEN t.key = own_key THEN 'exact' ELSE 'alias' END ELSE how END AS how FROM t JOIN dec ON dec.key = t.key AND dec.within IS NOT DISTINCT FROM t.within),
    per AS (SELECT raw, hint, arg_min(gid, n) FILTER (WHERE n <= 2 AND gid IS NOT NULL) AS g1, arg_min(how, n) FILTER (WHERE n <= 2 AND gid IS NOT NULL) AS h1, bool_or(n <= 2 AND how = 'contradicted') AS against, arg_min(gid, n) FILTER (WHERE n > 2 AND gid IS NOT NULL) AS g2, arg_min(how, n) FILTER (WHERE n > 2 AND gid IS NOT NULL) AS h2 FROM tr GROUP BY raw, hint),
    x AS (SELECT w.*, coalesce(per.g1, CASE WHEN against AND country IS NULL THEN per.g2 END) AS gid, coalesce(h1, CASE WHEN against AND country IS NULL THEN h2 END) AS how, coalesce(against, false) AS against FROM w LEFT JOIN per ON per.raw = w.raw AND per.hint IS NOT DISTINCT FROM w.hint),
    y AS (SELECT x.raw, x.hint, g.name AS place, g.geonameid, CASE WHEN gid IS NOT NULL THEN g.countrycode WHEN against THEN NULL ELSE country END AS country_code, head_code IS NOT NULL AND NOT no_city AS is_country, no_city, how, gid, head, contains(head, '/') OR NOT regexp_matches(head, '[A-Za-z]') AS odd FROM x LEFT JOIN g ON g.geonameid = gid),
    res AS (SELECT raw, hint, CASE WHEN gid IS NOT NULL THEN place WHEN no_city OR is_country OR odd THEN NULL ELSE head END AS city, geonameid, country_code, CASE WHEN no_city THEN 'unknown' WHEN gid IS NOT NULL THEN how WHEN is_country AND country_code IS NOT NULL THEN 'country_only' WHEN is_country OR odd THEN 'unknown' ELSE 'unverified' END AS quality FROM y),
    placed AS (SELECT mention_id, city, {_FOLD.format("city")} AS city_key, geonameid, country_code, coalesce(quality, 'unknown') AS quality, coalesce('geonames:' || geonameid, {_FOLD.format("city")}) AS place_key FROM m LEFT JOIN res ON res.raw = m.raw AND res.hint IS NOT DISTINCT FROM m.country_hint)"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: D.table(spark, sf_dir, t) for t in ("nation", "region", "customer") if f" {t}" in sql}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql.replace("VARCHAR", "STRING"), **tables)


def _gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _view(spark, sf_dir, _GAZETTEER).withColumn("alternatenames", F.array_compact(F.array("alias")))
    return P.place_keys(rows), _view(spark, sf_dir, _COUNTRIES)


@query(f"WITH {resolved_sql(_MENTIONS)} SELECT mention_id, city, city_key, geonameid, country_code, quality, place_key FROM placed")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location strings of every kind resolved against the gazetteer."""
    keys, countries = _gazetteer(spark, sf_dir)
    out = P.resolved(_view(spark, sf_dir, _MENTIONS), keys, countries, ["R1", "R2"])
    return out.select("mention_id", "city", "city_key", "geonameid", "country_code", "quality", "place_key")


@query(f"WITH {resolved_sql(_MENTIONS)} SELECT quality, country_code, count(*) AS n, count(DISTINCT place_key) AS places FROM placed GROUP BY quality, country_code")
def place_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mentions matched how, and where."""
    return resolved_places(spark, sf_dir).groupBy("quality", "country_code").agg(F.count("*").alias("n"), F.count_distinct("place_key").alias("places"))


@query("SELECT o_custkey AS founder_id, min(n_regionkey) AS country_code FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 GROUP BY o_custkey HAVING count(DISTINCT n_regionkey) = 1")
def founder_country_by_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country all of a founder's known schools agree on."""
    orders = D.table(spark, sf_dir, "orders")
    education = orders.select(F.col("o_custkey").alias("founder_id"), F.concat(F.lit("The University of NATION "), (F.col("o_orderkey") % 25).cast("string"), F.lit(" (UN)")).alias("school"))
    aliases = D.table(spark, sf_dir, "nation").select(F.concat(F.lit("university nation "), F.col("n_nationkey").cast("string")).alias("alias_key"), F.col("n_regionkey").alias("country_code"))
    return P.agreed_country(education, aliases)


# Founders' strings, hinted by their schools (suppliers' nations): a sweep over them against what was stored before.
_SCHOOLS = "SELECT c_custkey AS founder_id, 'School ' || (c_custkey % 40) AS school FROM customer UNION ALL SELECT c_custkey, 'School ' || (c_custkey % 20) FROM customer WHERE c_custkey % 4 = 0"
_SWEPT = _MENTIONS.replace("CASE WHEN c_custkey % 3 = 0 THEN 'R' || (c_custkey % 6) END AS country_hint", "CASE WHEN c_custkey % 4 <> 0 OR (c_custkey % 40) % 5 = (c_custkey % 20) % 5 THEN 'R' || ((c_custkey % 40) % 5) END AS country_hint")
_BEFORE = "CASE WHEN mention_id % 6 = 0 THEN NULL WHEN mention_id % 6 = 1 THEN 'elsewhere' ELSE {0} END"


@query(
    f"""WITH {resolved_sql(_SWEPT)}, b AS (SELECT *, {_BEFORE.format("city")} AS old_city, {_BEFORE.format("quality")} AS old_quality FROM placed)
    SELECT mention_id AS founder_id, old_city AS city_before, city AS city_after, old_quality AS location_quality_before, quality AS location_quality_after, country_code FROM b WHERE old_city IS DISTINCT FROM city OR old_quality IS DISTINCT FROM quality"""
)
def location_sweep_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every founder's place resolved anew with the country of their schools: the rows that change, before and after."""
    keys, countries = _gazetteer(spark, sf_dir)
    founders = _view(spark, sf_dir, _SWEPT).select(F.col("mention_id").alias("founder_id"), F.col("raw").alias("raw_location"))
    schools = _view(spark, sf_dir, _SCHOOLS)
    aliases = spark.range(40).select(F.concat(F.lit("school "), F.col("id").cast("string")).alias("alias_key"), F.concat(F.lit("R"), (F.col("id") % 5).cast("string")).alias("country_code"))
    after = P.located(founders, schools, aliases, keys, countries, ["R1", "R2"])
    old = lambda c: F.when(F.col("founder_id") % 6 == 0, None).when(F.col("founder_id") % 6 == 1, "elsewhere").otherwise(F.col(c)).alias(c)
    before = after.select("founder_id", old("city"), old("location_quality"))
    out = R.changed(before, after, "founder_id", "city", "location_quality")
    return out.join(after.select("founder_id", "country_code"), "founder_id")
