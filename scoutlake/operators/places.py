"""Place resolution: location strings to countries and gazetteer places, with how each matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import saved

#: What makes a namesake decisive, the share a place of the preferred region needs to break a tie, and the
#: letters an alias needs.
DOMINANCE, PRIOR_SHARE, ALIAS_LETTERS = 10, 0.5, 4
#: Spellings that lead to an official name, further names of countries, and words that are no city.
SPELLINGS = {"munchen": "munich", "muenchen": "munich", "tuebingen": "tubingen", "goettingen": "gottingen"}
COUNTRIES = {"germany": "DE", "deutschland": "DE", "uk": "GB", "united kingdom": "GB", "england": "GB", "france": "FR", "usa": "US", "us": "US", "united states": "US"}
NO_CITY = ["", "null", "none", "n/a", "na", "unknown", "tum", "lmu", "eth", "mit"]
PLACE = ["geonameid", "name", "countrycode", "population"]


def place_keys(gazetteer: DataFrame) -> DataFrame:
    """(geonameid, name, countrycode, population, alternatenames) -> (city_key, official, place): one row for each key that
    a place is known by, its own name or an alias of four letters or more. A key may have several owners."""
    place = F.struct(*PLACE).alias("place")
    own = gazetteer.select(K.city_key(F.col("name")).alias("city_key"), F.lit(True).alias("official"), place)
    alias = gazetteer.select(F.explode("alternatenames").alias("alias"), place).select(K.city_key(F.col("alias")).alias("city_key"), F.lit(False).alias("official"), "place").filter(F.length("city_key") >= ALIAS_LETTERS)
    both = own.unionByName(alias).filter("city_key is not null")
    return both.groupBy("city_key", "place.geonameid").agg(F.max("official").alias("official"), F.any_value("place").alias("place")).drop("geonameid")


def country_names(countries: DataFrame) -> DataFrame:
    """(name, code) -> (country_key, code), with the further names."""
    more = F.explode(F.array(*(F.struct(F.lit(k).alias("country_key"), F.lit(v).alias("code")) for k, v in COUNTRIES.items())))
    fixed = countries.sparkSession.range(1).select(more.alias("c")).select("c.*", F.lit(0).alias("_from"))
    known = countries.select(F.trim(K.fold(F.col("name"))).alias("country_key"), "code", F.lit(1).alias("_from")).filter("country_key <> '' and code is not null")
    return fixed.unionByName(known).groupBy("country_key").agg(F.max_by("code", F.struct("_from", "code")).alias("code"))


def decisive(candidates: DataFrame, key: list[str], preferred: list[str]) -> DataFrame:
    """For each key the place that wins among its candidates, and how: sole, population (ten times the runner-up), or prior
    (the field narrows to the preferred region's, which must have half the leader's size). No winner, no row.

    Only the best two of all and of the preferred region matter, so a window's ranks are enough."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("population"), "geonameid")
    inside = F.coalesce(F.col("countrycode").isin(preferred), F.lit(False)) if preferred else F.lit(False)
    ranked = candidates.withColumn("_inside", inside)
    wi = Window.partitionBy(*key, "_inside").orderBy(F.desc_nulls_last("population"), "geonameid")
    ranked = ranked.withColumn("_r", F.row_number().over(w)).withColumn("_ri", F.when(F.col("_inside"), F.row_number().over(wi)))
    pop = F.coalesce("population", F.lit(0))
    at = lambda r, n, v: F.max(F.when(F.col(r) == n, v))
    place = F.struct(*PLACE)
    top = ranked.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("_inside").alias("ni"), at("_r", 1, place).alias("lead"), at("_r", 1, pop).alias("p1"), at("_r", 2, pop).alias("p2"), at("_ri", 1, place).alias("lead_in"), at("_ri", 1, pop).alias("i1"), at("_ri", 2, pop).alias("i2"))
    prior = (F.col("ni") > 0) & (F.col("ni") < F.col("n")) & (F.col("i1") >= PRIOR_SHARE * F.col("p1")) & ((F.col("ni") == 1) | (F.col("i1") >= DOMINANCE * F.greatest("i2", F.lit(1))))
    how = F.when(F.col("n") == 1, "sole").when(F.col("p1") >= DOMINANCE * F.greatest("p2", F.lit(1)), "population").when(prior, "prior")
    won = top.withColumn("how", how).filter("how is not null")
    return won.select(*key, F.when(F.col("how") == "prior", F.col("lead_in")).otherwise(F.col("lead")).alias("place"), "how")


def decided(asked: DataFrame, keys: DataFrame, preferred: list[str]) -> DataFrame:
    """(city_key, hint) -> (city_key, hint, place, how): how a name, within a country if one is given, finds its place.

    Official owners of the name are weighed among themselves, with the preferred region's prior, and all owners among
    themselves without. An alias wins over an official name only at ten times its size (`inferred`). `contradicted`: the
    name is known, but not in that country; `unverified`: unknown, or namesakes of like size."""
    asked = asked.select("city_key", "hint").distinct()
    met = asked.join(keys, "city_key").select("city_key", "hint", "official", "place.*")
    fits = met.filter(F.col("hint").isNull() | (F.col("hint") == F.col("countrycode")))
    # null-safe keys for the joins below
    mark = lambda df: df.withColumn("_hint", F.coalesce("hint", F.lit(""))).drop("hint")
    key = ["city_key", "_hint"]
    named = decisive(mark(fits.filter("official")), key, preferred).select(*key, F.col("place").alias("named"), F.col("how").alias("named_how"))
    pool = decisive(mark(fits), key, []).select(*key, F.col("place").alias("pool"), F.col("how").alias("pool_how"))
    seen = mark(met).groupBy(*key).agg(F.bool_or((F.col("_hint") == "") | (F.col("_hint") == F.col("countrycode"))).alias("fits"))
    rows = mark(asked.withColumn("asked", F.col("hint"))).join(seen, key, "left").join(named, key, "left").join(pool, key, "left")
    size = lambda p: F.coalesce(F.col(p)["population"], F.lit(0))
    overruled = F.col("pool").isNotNull() & F.col("named").isNotNull() & (size("pool") >= DOMINANCE * F.greatest(size("named"), F.lit(1)))
    how = (
        F.when(overruled, "inferred").when(F.col("named_how") == "prior", "prior").when(F.col("named").isNotNull(), "named").when(F.col("pool_how") == "sole", "alias").when(F.col("pool").isNotNull(), "inferred")
        .when((F.col("_hint") != "") & F.col("fits").isNotNull() & ~F.coalesce("fits", F.lit(False)), "contradicted").otherwise("unverified")
    )
    place = F.when(overruled | F.col("named").isNull(), F.col("pool")).otherwise(F.col("named"))
    return rows.select("city_key", F.col("asked").alias("hint"), place.alias("place"), how.alias("how"))


def _without_umlauts(key: Column) -> Column:
    """German ue, oe and ae as u, o and a."""
    return F.replace(F.replace(F.replace(key, F.lit("ue"), F.lit("u")), F.lit("oe"), F.lit("o")), F.lit("ae"), F.lit("a"))


def _spelled(key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv)), key), key)


def resolved(mentions: DataFrame, keys: DataFrame, countries: DataFrame, preferred: list[str]) -> DataFrame:
    """(mention_id, raw, country_hint) -> (mention_id, raw, city, city_key, country_code, quality, geonameid, place_key).

    A string's first part is the place and a later part (or the only one) its country. A stated country narrows the
    gazetteer, else the hint does; a hint that the name contradicts is dropped, a stated country then makes the place
    unverified. A country's name alone is `country_only`, unless a city bears it. Each different string with its hint is
    resolved once; rows of a common one are joined to it."""
    text = F.trim("raw")
    asked = mentions.select("raw", F.col("country_hint").alias("hint")).distinct().withColumn("parts", F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""))
    asked = asked.withColumn("head", F.when(F.size("parts") > 0, F.element_at("parts", 1)).otherwise(text)).withColumn("_id", F.xxhash64(F.coalesce("raw", F.lit("")), F.coalesce("hint", F.lit("")), F.col("raw").isNull(), F.col("hint").isNull()))
    names = country_names(countries)
    later = F.when(F.size("parts") > 1, F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts"))
    stated = asked.select("_id", F.posexplode(later).alias("pos", "part")).withColumn("country_key", F.trim(K.fold(F.col("part")))).join(names, "country_key").groupBy("_id").agg(F.max_by("code", "pos").alias("stated"))
    rows = asked.withColumn("country_key", F.trim(K.fold(F.col("head")))).join(stated, "_id", "left").join(names.withColumnRenamed("code", "head_code"), "country_key", "left")
    rows = rows.withColumn("country", F.coalesce("stated", "head_code")).withColumn("own_key", K.city_key(F.col("head")))
    rows = saved(rows)  # read by what follows and by its lookups
    placeable = ~F.col("country_key").isin(NO_CITY) & F.col("own_key").isNotNull()
    first = _spelled(F.col("own_key"))
    second = _without_umlauts(first)
    within = F.coalesce("country", "hint")
    tries = F.array_compact(F.array(
        F.struct(F.lit(1).alias("n"), first.alias("city_key"), within.alias("hint")), F.when(second != first, F.struct(F.lit(2).alias("n"), _spelled(second).alias("city_key"), within.alias("hint"))),
        F.when(F.col("country").isNull() & F.col("hint").isNotNull(), F.struct(F.lit(3).alias("n"), first.alias("city_key"), F.lit(None).cast("string").alias("hint"))),
        F.when(F.col("country").isNull() & F.col("hint").isNotNull() & (second != first), F.struct(F.lit(4).alias("n"), _spelled(second).alias("city_key"), F.lit(None).cast("string").alias("hint"))),
    ))
    tried = rows.filter(placeable).select("_id", "own_key", F.explode(tries).alias("t")).select("_id", "own_key", "t.*")
    found = decided(tried, keys, preferred)
    tried = tried.withColumn("_h", F.coalesce("hint", F.lit(""))).drop("hint").join(found.withColumn("_h", F.coalesce("hint", F.lit(""))).drop("hint"), ["city_key", "_h"])
    answer = F.struct(F.col("place"), F.when(F.col("how") == "named", F.when(F.col("city_key") == F.col("own_key"), "exact").otherwise("alias")).otherwise(F.col("how")).alias("how"))
    hinted, free = F.col("n") <= 2, F.col("n") > 2
    best = lambda which: F.min_by(F.when(F.col("place").isNotNull() & which, answer), F.when(F.col("place").isNotNull() & which, F.col("n")))
    per = tried.groupBy("_id").agg(best(hinted).alias("one"), F.bool_or(hinted & (F.col("how") == "contradicted")).alias("against"), best(free).alias("two"))
    rows = rows.join(per, "_id", "left")
    use = F.when(F.col("one").isNotNull(), F.col("one")).when(F.col("against") & F.col("country").isNull(), F.col("two"))
    rows = rows.withColumn("a", use)
    place, against = F.col("a.place"), F.coalesce("against", F.lit(False)) & F.col("a").isNull()
    is_country = F.col("head_code").isNotNull() & F.coalesce(~F.col("country_key").isin(NO_CITY), F.lit(False))
    # with a hint against the name and no place without it either, there is no stated country to drop
    country = F.when(~against, F.col("country"))
    blank = F.col("raw").isNull() | (text == "")
    letters = F.col("head").rlike(r"\p{L}") & ~F.col("head").contains("/")
    kept = ~blank & placeable_head(F.col("country_key")) & F.col("a").isNull() & ~is_country & letters
    quality = (
        F.when(blank, "unknown").when(F.col("country_key").isin(NO_CITY), "unknown").when(place.isNotNull(), F.col("a.how")).when(is_country & country.isNotNull(), "country_only")
        .when(is_country, "unknown").when(kept, "unverified").otherwise("unknown")
    )
    city = F.when(place.isNotNull(), place["name"]).when(kept, F.col("head"))
    code = F.when(blank, None).when(place.isNotNull(), F.coalesce(F.nullif(place["countrycode"], F.lit("")), F.col("country"))).otherwise(country)
    out = rows.select(F.col("raw").alias("_raw"), F.col("hint").alias("_hint"), city.alias("city"), K.city_key(city).alias("city_key"), code.alias("country_code"), quality.alias("quality"), F.when(~blank, place["geonameid"]).alias("geonameid"))
    out = out.withColumn("place_key", F.coalesce(F.concat(F.lit("geonames:"), F.col("geonameid").cast("string")), F.col("city_key")))
    out = saved(out)
    joined = mentions.join(out, F.col("raw").eqNullSafe(F.col("_raw")) & F.col("country_hint").eqNullSafe(F.col("_hint")))
    return joined.select("mention_id", "raw", "city", "city_key", "country_code", "quality", "geonameid", "place_key")


def placeable_head(country_key: Column) -> Column:
    return F.coalesce(~country_key.isin(NO_CITY), F.lit(False))


def agreed_country(education: DataFrame, aliases: DataFrame) -> DataFrame:
    """(founder_id, school) and (alias_key, country_code) -> the one country that all of a founder's known schools are in."""
    keyed = education.withColumn("alias_key", K.institution_key(F.col("school"))).join(aliases.filter("country_code is not null"), "alias_key")
    return keyed.groupBy("founder_id").agg(F.count_distinct("country_code").alias("n"), F.min("country_code").alias("country_code")).filter("n = 1").drop("n")


def located(founders: DataFrame, education: DataFrame, aliases: DataFrame, keys: DataFrame, countries: DataFrame, preferred: list[str]) -> DataFrame:
    """(founder_id, raw_location) with all place columns resolved anew, narrowed by the country of the founder's schools."""
    hints = agreed_country(education, aliases).select("founder_id", F.col("country_code").cast("string").alias("country_hint"))
    mentions = founders.select(F.col("founder_id").alias("mention_id"), F.col("raw_location").alias("raw"), "founder_id").join(hints, "founder_id", "left").drop("founder_id")
    out = resolved(mentions, keys, countries, preferred)
    return out.select(F.col("mention_id").alias("founder_id"), F.col("raw").alias("raw_location"), "city", "city_key", F.col("geonameid").alias("city_geonameid"), "country_code", F.col("quality").alias("location_quality"))
