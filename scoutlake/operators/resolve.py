"""Entity resolution: which known person a mention is, and which known people are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import groups, large, saved

# Similarity gates and confidences of the resolution rules.
SAME_NAME, MERGE_NAME = 96, 90
MERGE_AT, REVIEW_AT = 0.90, 0.55
BY_HANDLE, BY_ARTIFACT, BY_CONTEXT = 0.99, 0.97, 0.89
NAME_SHARE, CONTEXT_SHARE = 0.7, 0.1


def shared_by_strangers(handles: DataFrame, names: DataFrame) -> DataFrame:
    """Handles (kind, value) that people of different names claim: they identify nobody. Claimants count by name, so rows
    of one person do not withdraw their own handle."""
    return handles.join(names, "id").groupBy("kind", "value").agg(F.min("name").alias("_least"), F.max("name").alias("_most")).filter("_least <> _most").select("kind", "value")


def _people(people: DataFrame, prefix: str) -> DataFrame:
    """(id, display_name, city, company, education) with comparison keys, columns prefixed."""
    keyed = people.repartition("id").select(  # a small file is one split, and its names and texts are work
        "id", K.compact_name(F.col("display_name")).alias("name"), K.city_key(F.col("city")).alias("city"), F.nullif(K.comparison_text(F.col("company")), F.lit("")).alias("company"),
        F.transform(F.coalesce("education", F.array().cast("array<string>")), lambda s: K.comparison_text(s)).alias("education"),
    )
    keyed = keyed.withColumn("alike", F.sha2(F.to_json(F.struct("name", "city", "company", "education")), 256))
    return keyed.select(*(F.col(c).alias(f"{prefix}{c}") for c in keyed.columns))


def _grouped(people: DataFrame, prefix: str, handles: DataFrame) -> DataFrame:
    """People with their group: those of equal keys and kinds of handles. As long as a person shares no handle or artifact with
    another, the other's score is the same for all of a group."""
    kinds = handles.filter(F.col("kind").isin(*K.STRONG_KINDS)).groupBy(F.col("id").alias(f"{prefix}id")).agg(F.array_sort(F.collect_set("kind")).alias("_kinds"))
    out = large(people).join(large(kinds), f"{prefix}id", "left")
    return out.withColumn(f"{prefix}group", F.concat_ws(",", f"{prefix}alike", "_kinds")).drop("_kinds")


def _first_of_group(people: DataFrame, prefix: str) -> DataFrame:
    first = people.groupBy(f"{prefix}group").agg(F.min(f"{prefix}id").alias(f"{prefix}id")).select(f"{prefix}id")
    return large(people.join(first, f"{prefix}id", "left_semi"))


def _by_kind(handles: DataFrame) -> DataFrame:
    """(id, kind, value) -> one row per id with a map from kind to its values."""
    per = handles.groupBy("id", "kind").agg(F.collect_set("value").alias("values"))
    return large(per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "values"))).alias("handles")))


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different compact names -> all pairs (i_name, e_name) of different ones whose ratio is SAME_NAME or more.

    Names of together S letters may differ by k = S (100 - SAME_NAME) / 100 letters put in or left out. One letter is an
    equi-join of names with names less a letter. For more, names that share a part of the right one,
    at most k places away, are an equi-join (`shared_parts`), whose pairs name_ratio verifies."""
    i, e = (saved(x.select("name", F.length("name").alias("n")).filter("n >= 12").distinct()) for x in (left, right))

    def less_one(rows: DataFrame) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), "n"), lambda at: F.concat(F.substring("name", F.lit(1), at - 1), F.substring("name", at + 1, F.col("n"))))
        return rows.filter("n >= 13").select("name", F.explode(F.array_distinct(cut)).alias("short"))

    one = less_one(i).join(e.select(F.col("name").alias("short")), "short").select(F.col("name").alias("i_name"), F.col("short").alias("e_name"))
    one = one.unionByName(less_one(e).join(i.select(F.col("name").alias("short")), "short").select(F.col("short").alias("i_name"), F.col("name").alias("e_name")))

    more = shared_parts(i, e).filter("i_name <> e_name").distinct()
    return one.unionByName(more.filter(K.name_ratio(F.col("i_name"), F.col("e_name")) >= SAME_NAME)).distinct()


#: A part of a name that more names than this have in one place is hot.
HOT_PART = 64


def shared_parts(i: DataFrame, e: DataFrame, hot_above: int = HOT_PART) -> DataFrame:
    """(name, n) of two sides -> (i_name, e_name), with repeats: all pairs that k letters put in or left out can explain, and
    some others.

    The right name falls into k + 1 parts, of which k changes leave one as it is. A name of which one of these is hot, say a
    common first name, falls into 2k + 1 finer ones instead, of which k changes leave k + 1 as they are: it meets others on
    its k + 1 rarest parts, which hot letters can cover only if they are most of the name. Both ways find every pair.
    Hot parts and the names that have one are saved: they are read several times, and most tables have none."""
    key = ["i_n", "e_n", "fine", "j", "part"]

    def parts(rows: DataFrame, own: str, other: str, fine: bool) -> DataFrame:
        """Each name with the lengths of names it can meet, and the bounds of the parts of the right one."""
        out = rows.withColumnRenamed("n", own).withColumn(other, F.explode(F.sequence(F.expr(f"{own} - {own} div 11"), F.expr(f"{own} + {own} div 11"))))
        out = out.withColumn("k", F.expr(f"cast((i_n + e_n) * {100 - SAME_NAME} div 100 as int)")).filter("k >= 2 and abs(i_n - e_n) <= k")
        out = out.withColumn("of", F.expr("2 * k + 1" if fine else "k + 1")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumn("fine", F.lit(fine))
        return out.withColumn("at", F.expr("cast(e_n * j div of as int)")).withColumn("size", F.expr("cast(e_n * (j + 1) div of as int) - at"))

    def whole(fine: bool) -> DataFrame:
        return parts(e, "e_n", "i_n", fine).withColumn("part", F.expr("substring(name, at + 1, size)")).select(F.col("name").alias("e_name"), "k", *key)

    def moved(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("at", F.explode(F.sequence(F.expr("greatest(0, at - k)"), F.expr("at + k")))).filter("at + size <= i_n")
        return at.withColumn("part", F.expr("substring(name, at + 1, size)")).select(F.col("name").alias("i_name"), *key).distinct()

    coarse = whole(False)
    hot = saved(coarse.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > hot_above).select(key))
    if hot.isEmpty():  # nothing is finer than the rest: one join
        return moved(parts(i, "i_n", "e_n", False)).join(coarse.select("e_name", *key), key).select("i_name", "e_name")
    crowded = saved(coarse.join(hot, key, "left_semi").select("e_name", "i_n", "e_n").distinct())
    finer = whole(True).join(crowded.select("e_name", "i_n"), ["e_name", "i_n"], "left_semi")
    finer = finer.join(finer.groupBy(key).agg(F.count("*").alias("n")), key)
    rarest = Window.partitionBy("e_name", "i_n").orderBy("n", "j")  # 2k + 1 rows each
    finer = finer.withColumn("_r", F.row_number().over(rarest)).filter("_r <= k + 1")
    kept = coarse.join(crowded.select("e_name", "i_n"), ["e_name", "i_n"], "left_anti").select("e_name", *key).unionByName(finer.select("e_name", *key))
    lengths = crowded.select("i_n", "e_n").distinct()
    tried = moved(parts(i, "i_n", "e_n", False)).unionByName(moved(parts(i, "i_n", "e_n", True).join(lengths, ["i_n", "e_n"], "left_semi")))
    return tried.join(kept, key).select("i_name", "e_name")


def _named_alike(incoming: DataFrame, existing: DataFrame, near: DataFrame | None) -> DataFrame:
    """(i_id, e_id) of equal compact names or, with `near`, of those pairs of names."""
    pairs = incoming.select("i_id", F.col("i_name").alias("k")).filter("k <> ''").join(existing.select("e_id", F.col("e_name").alias("k")), "k").select("i_id", "e_id")
    if near is not None:
        pairs = pairs.unionByName(incoming.select("i_id", "i_name").join(near, "i_name").join(existing.select("e_id", "e_name"), "e_name").select("i_id", "e_id"))
    return pairs


def _of_one_handle(in_handles: DataFrame, ex_handles: DataFrame) -> DataFrame:
    a, b = (h.select(F.col("id").alias(f"{side}_id"), "kind", "value") for h, side in ((in_handles, "i"), (ex_handles, "e")))
    return a.join(b, ["kind", "value"]).select("i_id", "e_id")


#: Names that hold one handle are compared one by one up to so many; above that by `near_names`.
FEW_NAMES = 64


def _near_of_one_handle(incoming: DataFrame, existing: DataFrame, in_handles: DataFrame, ex_handles: DataFrame, few: int = FEW_NAMES) -> DataFrame:
    """(i_id, e_id) of near names that share a handle, also one that identifies nobody. Names are compared once a handle,
    however many people of that name hold it."""
    key = ["kind", "value"]

    def held(people: DataFrame, handles: DataFrame, side: str) -> DataFrame:
        rows = handles.filter(F.col("kind").isin(*K.STRONG_KINDS)).select(F.col("id").alias(f"{side}_id"), *key).distinct()
        return saved(large(rows).join(people.select(f"{side}_id", f"{side}_name"), f"{side}_id"))

    a, b = held(incoming, in_handles, "i"), held(existing, ex_handles, "e")
    i, e = (x.select(*key, f"{side}_name").distinct() for x, side in ((a, "i"), (b, "e")))
    names = i.withColumnRenamed("i_name", "name").unionByName(e.withColumnRenamed("e_name", "name")).distinct()
    several = saved(names.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"))
    i, e = (x.join(several, key) for x in (i, e))
    pairs = i.filter(F.col("n") <= few).join(e.drop("n"), key).filter("i_name <> e_name")
    changes = F.levenshtein("i_name", "e_name")  # no more than letters put in and left out, and a fraction of the ratio's work
    pairs = pairs.filter(changes * 100 <= (F.length("i_name") + F.length("e_name")) * (100 - SAME_NAME)).filter(K.name_ratio(F.col("i_name"), F.col("e_name")) >= SAME_NAME).select(*key, "i_name", "e_name")
    if not several.filter(F.col("n") > few).isEmpty():
        i, e = (x.filter(F.col("n") > few).drop("n") for x in (i, e))
        near = near_names(i.select(F.col("i_name").alias("name")), e.select(F.col("e_name").alias("name")))
        pairs = pairs.unionByName(i.join(near, "i_name").join(e, [*key, "e_name"]).select(*key, "i_name", "e_name"))
    pairs = large(pairs)
    return a.join(pairs, [*key, "i_name"]).join(b, [*key, "e_name"]).select("i_id", "e_id")


def _of_one_artifact(incoming: DataFrame, existing: DataFrame, near: DataFrame, in_artifacts: DataFrame, ex_artifacts: DataFrame) -> DataFrame:
    """(i_id, e_id) of those that share an artifact under the same or a near name, of each group the earliest: a page that names
    many joins nobody."""
    a = in_artifacts.select(F.col("id").alias("i_id"), "url").distinct().join(incoming.select("i_id", "i_name").filter("i_name <> ''"), "i_id")
    b = large(ex_artifacts.select(F.col("id").alias("e_id"), "url").join(existing.select("e_id", "e_name", "e_group"), "e_id").groupBy("url", "e_name", "e_group").agg(F.min("e_id").alias("e_id")))
    same = a.withColumnRenamed("i_name", "e_name").join(b, ["url", "e_name"]).select("i_id", "e_id")
    return same.unionByName(a.join(near, "i_name").join(b, ["url", "e_name"]).select("i_id", "e_id"))


def _known_handles(existing: DataFrame, in_handles: DataFrame, ex_handles: DataFrame, population: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Handles of both sides without those that strangers share."""
    names = existing.select("id", K.compact_name(F.col("display_name")).alias("name")) if population is None else population
    void = shared_by_strangers(large(ex_handles), names)
    return tuple(large(large(h).join(void, ["kind", "value"], "left_anti")) for h in (in_handles, ex_handles))


def scored(incoming: DataFrame, existing: DataFrame, in_handles: DataFrame, ex_handles: DataFrame, in_artifacts: DataFrame | None = None, ex_artifacts: DataFrame | None = None, population: DataFrame | None = None, near: bool = True, strangers: bool = False) -> DataFrame:
    """Every candidate pair with its score, reasons and conflicts: same or (with `near`) near compact name, or a shared handle.

    People: id, display_name, city, company, education; handles: id, kind, value (canonical); artifacts: id, url. Handles
    that strangers share, over `population` (the existing people unless given), neither join nor conflict; with `strangers`
    they make a pair of near names, which is then scored without them."""
    i = saved(_people(incoming, "i_"))  # read by several joins
    e = i.select(*(F.col(c).alias(f"e_{c[2:]}") for c in i.columns)) if existing is incoming else saved(_people(existing, "e_"))
    all_handles = in_handles, ex_handles
    in_handles, ex_handles = _known_handles(existing, in_handles, ex_handles, population)
    names = near_names(i.select(F.col("i_name").alias("name")), e.select(F.col("e_name").alias("name"))) if near else None
    pairs = _named_alike(i, e, names).unionByName(_of_one_handle(in_handles, ex_handles))
    if strangers and not near:
        pairs = pairs.unionByName(_near_of_one_handle(i, e, *all_handles))
    pairs = saved(pairs.distinct())
    return _scores(pairs, i, e, in_handles, ex_handles, in_artifacts, ex_artifacts)


def _scores(pairs: DataFrame, i: DataFrame, e: DataFrame, in_handles: DataFrame, ex_handles: DataFrame, in_artifacts: DataFrame | None = None, ex_artifacts: DataFrame | None = None) -> DataFrame:
    """(i_id, e_id) pairs with their score, reasons and conflicts."""
    if in_artifacts is None or ex_artifacts is None:
        rows = pairs.join(i, "i_id").join(e, "e_id").withColumn("n_artifacts", F.lit(0))
    else:
        met = pairs.join(large(in_artifacts).select(F.col("id").alias("i_id"), "url").distinct(), "i_id")
        art = large(met.join(large(ex_artifacts).select(F.col("id").alias("e_id"), "url").distinct(), ["e_id", "url"]).groupBy("i_id", "e_id").agg(F.count("*").alias("n_artifacts")))
        rows = pairs.join(i, "i_id").join(e, "e_id").join(art, ["i_id", "e_id"], "left")
    rows = rows.join(_by_kind(in_handles).select(F.col("id").alias("i_id"), F.col("handles").alias("i_handles")), "i_id", "left").join(_by_kind(ex_handles).select(F.col("id").alias("e_id"), F.col("handles").alias("e_handles")), "e_id", "left")
    similarity = F.when(F.col("i_name") == F.col("e_name"), 100.0).otherwise(K.name_ratio(F.col("i_name"), F.col("e_name")))
    rows = rows.withColumn("similarity", similarity)
    kinds = F.array(*map(F.lit, K.STRONG_KINDS))

    def of(side: str, kind: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(f"{side}_handles"), kind), F.array().cast("array<string>"))

    shared = F.filter(kinds, lambda k: F.arrays_overlap(of("i", k), of("e", k)))
    apart = F.filter(kinds, lambda k: (F.size(of("i", k)) > 0) & (F.size(of("e", k)) > 0) & ~F.arrays_overlap(of("i", k), of("e", k)))
    rows = rows.withColumn("shared", shared).withColumn("apart", F.when(F.col("similarity") >= SAME_NAME, apart).otherwise(F.array().cast("array<string>")))
    named, close = F.col("similarity") >= SAME_NAME, F.col("similarity") >= MERGE_NAME
    # a shared handle under one name outranks a disagreement elsewhere
    conflicts = F.concat(F.when(~close, F.col("shared")).otherwise(F.array().cast("array<string>")), F.when(close & (F.size("shared") > 0), F.array().cast("array<string>")).otherwise(F.col("apart")))
    city, company = (F.coalesce(F.col(f"i_{c}") == F.col(f"e_{c}"), F.lit(False)) for c in ("city", "company"))
    school = F.arrays_overlap("i_education", "e_education")
    context = city.cast("int") + company.cast("int") + F.coalesce(school, F.lit(False)).cast("int")
    by_artifact = named & (F.coalesce("n_artifacts", F.lit(0)) > 0)
    reasons = F.array_compact(F.array(F.when(city, "city"), F.when(company, "company"), F.when(school, "education"), F.when(named, "name"), F.when(by_artifact, "artifact")))
    reasons = F.sort_array(F.concat(reasons, F.when(close, F.col("shared")).otherwise(F.array().cast("array<string>"))))
    score = (
        F.when(F.size(conflicts) > 0, 0.0).when(close & (F.size("shared") > 0), BY_HANDLE).when(by_artifact, BY_ARTIFACT).when(named & (context >= 2), BY_CONTEXT)
        .otherwise(F.least(F.lit(BY_CONTEXT), F.col("similarity") / 100 * NAME_SHARE + context * CONTEXT_SHARE))
    )
    return rows.select("i_id", "e_id", "similarity", score.alias("score"), reasons.alias("reasons"), conflicts.alias("conflicts"), named.alias("named"))


def _verdicts(pairs: DataFrame, stays: Column) -> DataFrame:
    """(i_id, best, clash): of a mention's pairs the best without conflict and the earliest in conflict."""
    clean = F.size("conflicts") == 0  # null orders do not count
    best = F.min_by(F.struct("e_id", "score", "reasons", "named"), F.when(clean, F.struct(~stays, -F.col("score"), F.col("e_id"))))
    clash = F.min_by(F.struct("e_id", "conflicts"), F.when(~clean, F.col("e_id")))
    return large(pairs.groupBy("i_id").agg(best.alias("best"), clash.alias("clash")))


def decided(incoming: DataFrame, pairs: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """The action for each mention: merge, review or new; the best pair without conflict wins, ties go to the earliest
    person, and a conflict decides only where nothing reaches the review level.

    holders: (i_id, e_id), who was given the same mention before. As long as the evidence it brought still makes them one,
    it stays there, even if others hold the same by now."""
    stays = F.lit(False)
    if holders is not None:
        pairs = large(pairs).join(holders.select("i_id", "e_id", F.lit(True).alias("_held")), ["i_id", "e_id"], "left")
        stays = F.coalesce("_held", F.lit(False)) & (F.col("score") >= MERGE_AT)
    per = _verdicts(pairs, stays)
    rows = incoming.select(F.col("id").alias("i_id")).join(per, "i_id", "left")
    conflicted = (F.col("best").isNull() | (F.col("best.score") < REVIEW_AT)) & F.col("clash").isNotNull()
    decision = F.when(conflicted, "review").when(F.col("best").isNull(), "new").when(F.col("best.score") >= MERGE_AT, "merge").when((F.col("best.score") >= REVIEW_AT) & F.col("best.named"), "review").otherwise("new")
    rows = rows.withColumn("decision", decision).withColumn("conflicted", conflicted)
    score = F.when(F.col("conflicted"), 0.0).otherwise(F.round(F.coalesce("best.score", F.lit(0.0)), 3))
    matched = F.when(F.col("conflicted"), F.col("clash.e_id")).otherwise(F.col("best.e_id"))
    method = F.when(F.col("conflicted"), "conflict").when(F.col("decision") == "review", "review").when(F.col("decision") == "new", "new").when(F.arrays_overlap("best.reasons", F.array(*map(F.lit, K.STRONG_KINDS))), "exact_key").when(F.array_contains("best.reasons", "artifact"), "artifact").otherwise("evidence")
    return rows.select(F.col("i_id").alias("id"), "decision", score.alias("confidence"), matched.alias("matched_id"), method.alias("method"))


def resolved(incoming: DataFrame, existing: DataFrame, in_handles: DataFrame, ex_handles: DataFrame, in_artifacts: DataFrame | None = None, ex_artifacts: DataFrame | None = None, holders: DataFrame | None = None) -> DataFrame:
    """The action for every mention. holders: as in `decided`.

    A name alone is weighed once for each two groups (`_grouped`), by their earliest people, so that a common name makes as many
    pairs as it has different contexts and not the square of its bearers. Pairs of one handle, of one artifact under one
    name, and those that were placed before are weighed one by one. What such a pair knows more than its groups only adds to its
    score, or takes away a conflict of one that then wins, so the better of both is what all pairs would give."""
    in_handles, ex_handles = _known_handles(existing, in_handles, ex_handles)
    i, e = saved(_grouped(_people(incoming, "i_"), "i_", in_handles)), saved(_grouped(_people(existing, "e_"), "e_", ex_handles))
    near = saved(near_names(i.select(F.col("i_name").alias("name")), e.select(F.col("e_name").alias("name"))))
    first_i, first_e = _first_of_group(i, "i_"), _first_of_group(e, "e_")
    kinds = [h.select("id", "kind", F.lit(side).alias("value")) for h, side in ((in_handles, "incoming"), (ex_handles, "existing"))]  # no value in common
    groups_met = _verdicts(_scores(saved(_named_alike(first_i, first_e, near)), first_i, first_e, *kinds), F.lit(False))
    by_name = i.select("i_group", "i_id").join(large(first_i.select(F.col("i_id").alias("_first"), "i_group").join(groups_met.withColumnRenamed("i_id", "_first"), "_first")), "i_group")
    none = F.array().cast("array<string>")
    best = by_name.filter("best is not null").select("i_id", "best.e_id", "best.score", "best.reasons", none.alias("conflicts"), "best.named")
    clash = by_name.filter("clash is not null").select("i_id", "clash.e_id", F.lit(0.0).alias("score"), none.alias("reasons"), "clash.conflicts", F.lit(True).alias("named"))
    pairs = _of_one_handle(in_handles, ex_handles)
    if in_artifacts is not None and ex_artifacts is not None:
        pairs = pairs.unionByName(_of_one_artifact(i, e, near, large(in_artifacts), large(ex_artifacts)))
    if holders is not None:
        held = large(holders).select("i_id", "e_id").join(i.select("i_id", "i_name"), "i_id").join(e.select("e_id", "e_name"), "e_id")
        same = F.when(F.col("i_name") == F.col("e_name"), F.col("i_name") != "").otherwise(K.name_ratio(F.col("i_name"), F.col("e_name")) >= SAME_NAME)
        pairs = pairs.unionByName(held.filter(same).select("i_id", "e_id"))
    own = _scores(saved(pairs.distinct()), i, e, in_handles, ex_handles, in_artifacts, ex_artifacts)
    columns = best.columns
    return decided(incoming, best.unionByName(clash).unionByName(own.select(*columns)), holders)


def merges(people: DataFrame, handles: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(id, canonical) for people that are one: an identifying handle, or an artifact under the same name where no handle
    speaks against it, shared by several.

    Everyone who shares a handle is hung on its least owner: a star per handle, not all pairs. For artifacts, rows of equal
    handles count as one and only different ones are compared."""
    names = large(people.select("id", K.compact_name(F.col("display_name")).alias("name")))
    void = shared_by_strangers(handles, names)
    good = large(large(handles).join(void, ["kind", "value"], "left_anti"))
    least = good.groupBy("kind", "value").agg(F.min("id").alias("left"), F.max("id").alias("_most")).filter("left <> _most").drop("_most")
    links = good.join(least, ["kind", "value"]).select("left", F.col("id").alias("right"))
    if artifacts is not None:
        keyed = large(artifacts).join(names, "id").join(_by_kind(good), "id", "left").withColumn("sig", F.sha2(F.coalesce(F.to_json(F.array_sort(F.map_entries("handles"))), F.lit("")), 256))
        one = large(keyed.groupBy("name", "url", "sig").agg(F.min("id").alias("rep"), F.any_value("handles").alias("handles")))
        links = links.unionByName(keyed.join(one.select("name", "url", "sig", "rep"), ["name", "url", "sig"]).select(F.col("rep").alias("left"), F.col("id").alias("right")))
        a, b = (one.select("name", "url", F.col("rep").alias(f"{s}_rep"), F.coalesce("handles", F.create_map().cast("map<string,array<string>>")).alias(f"{s}_h")) for s in ("a", "b"))
        against = F.exists(F.map_keys("a_h"), lambda k: F.map_contains_key("b_h", k) & ~F.arrays_overlap(F.element_at("a_h", k), F.coalesce(F.try_element_at("b_h", k), F.array().cast("array<string>"))))
        shared = F.exists(F.map_keys("a_h"), lambda k: F.coalesce(F.arrays_overlap(F.element_at("a_h", k), F.try_element_at("b_h", k)), F.lit(False)))
        links = links.unionByName(a.join(b, ["name", "url"]).filter("a_rep < b_rep").filter(shared | ~against).select(F.col("a_rep").alias("left"), F.col("b_rep").alias("right")))
    return groups(links)


def review_fingerprint(people: DataFrame, handles: DataFrame) -> DataFrame:
    """One stable key for each unresolved mention, equal for its replays."""
    wide = _by_kind(handles)
    kinds = [F.array_join(F.sort_array(F.coalesce(F.try_element_at("handles", F.lit(k)), F.array().cast("array<string>"))), ",") for k in K.STRONG_KINDS]
    return people.join(wide, "id", "left").select("id", F.sha2(F.to_json(F.struct(K.person_name(F.col("display_name")).alias("name"), F.coalesce(K.city_key(F.col("city")), F.lit("")).alias("city"), K.comparison_text(F.col("company")).alias("company"), *(k.alias(n) for k, n in zip(kinds, K.STRONG_KINDS)))), 256).alias("fingerprint"))


def mention_keys(people: DataFrame, handles: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, key): equal for mentions that say the same of the same evidence, so also for a mention that is delivered again. Sets of
    handles and pages enter by their size and two sums of hashes, however large they are."""

    def summed(rows: DataFrame, *columns: str) -> DataFrame:
        rows = rows.select("id", *columns).distinct()
        sums = (F.bit_xor(F.xxhash64(*(F.lit(seed), *columns))).cast("string") for seed in (1, 2))
        return large(rows.groupBy("id").agg(F.concat_ws(",", F.count("*").cast("string"), *sums).alias("sum")))

    rows = _people(people, "").select("id", "alike").join(summed(handles, "kind", "value").withColumnRenamed("sum", "h"), "id", "left").join(summed(artifacts, "url").withColumnRenamed("sum", "a"), "id", "left")
    return rows.select("id", F.sha2(F.concat_ws("|", "alike", F.coalesce("h", F.lit("")), F.coalesce("a", F.lit(""))), 256).alias("key"))


def first_claimant(handles: DataFrame, kind: str = "orcid") -> DataFrame:
    """Handles of a kind that only one person may hold: the earliest holder keeps it, later ones lose theirs."""
    w = Window.partitionBy("kind", F.lower("value")).orderBy("id")
    return handles.withColumn("_n", F.row_number().over(w)).filter((F.col("kind") != kind) | (F.col("_n") == 1)).drop("_n")
