"""Queries over whole deliveries, inbound decks, deals, searches and clean-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import delivery as V
from ..operators import intake as N
from ..operators import reconcile as C
from ..operators import resolve as R
from ..operators import views as W
from ..operators.graph import saved
from ..registry import query
from ..sources import domain as D
from ..sources.domain import sql

# Parts as mentions of people, a fifth of them in a delivery. Of every six mentions one shares its handle with a known person of
# its name, one's handle speaks against one, one is new (with another mention), one is known by its page, one by its name
# only, and one has one of the few common names; every seventh is a firm, every fourth comes without artifacts. Pages that
# the delivery brings share URLs by threes and contents by twos, so that their order decides what is stored.
_OWN = "'An' || translate(substr(md5('f' || {k}), 1, 12), '0123456789', 'ghijklmnop') || ' Von' || translate(substr(md5('l' || {k}), 1, 14), '0123456789', 'ghijklmnop')"
_MET = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 35 = 0 THEN 'Acme Ventures' WHEN j % 6 = 2 AND p_partkey % 5 = 0 THEN {_OWN.format(k="(j - j % 12 + 5000000000)")} WHEN j % 6 IN (0, 1, 3, 4) AND p_partkey % 5 < 2 THEN {_OWN.format(k="j")} ELSE p_name END AS display_name,
    CAST(p_size % 10 AS VARCHAR) AS city, lower(p_type) AS company, lower(p_brand) AS occupation,
    CASE WHEN p_partkey % 5 > 1 OR j % 6 = 5 THEN lower(replace(p_brand, '#', '-')) || '-' || p_size WHEN j % 6 = 0 THEN 'same-' || j WHEN j % 6 = 1 THEN 'own-' || p_partkey WHEN j % 6 = 2 AND p_partkey % 5 = 0 THEN 'new-' || (j - j % 12) END AS github,
    CASE WHEN p_partkey % 50 = 10 THEN '0000-0002-1825-0097' WHEN p_partkey % 50 = 20 THEN '0000-0002-1825-0098' END AS orcid, CASE WHEN p_partkey % 30 = 5 THEN 'https://www.linkedin.com/posts/Note-' || p_size END AS linkedin,
    round(0.4 + (p_partkey % 5) / 10.0, 2) AS discovery_confidence FROM (SELECT *, CAST(floor(p_partkey / 5) AS BIGINT) AS j FROM part)"""
_PAYLOADS = """SELECT p_partkey AS id, 0 AS pos, CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN j % 6 = 3 THEN 'https://e.test/p' || (p_partkey + 1) ELSE 'https://e.test/p' || (5 * (j - j % 3)) END AS canonical_url,
    CASE WHEN j % 6 = 3 THEN 'own' || j WHEN j % 6 = 4 AND j % 4 = 1 THEN 'h' || (p_partkey + 6) ELSE 'h' || (5 * (j + j % 2)) END AS content_hash FROM (SELECT *, CAST(floor(p_partkey / 5) AS BIGINT) AS j FROM part) WHERE p_partkey % 5 = 0"""
_STORED = "SELECT p_partkey AS signal_id, 'https://e.test/p' || p_partkey AS canonical_url, 'h' || p_partkey AS content_hash, CASE WHEN p_partkey % 3 = 0 THEN 'market' ELSE 'founder' END AS kind FROM part WHERE p_partkey % 5 = 1"


def _delivery(spark: SparkSession, sf_dir: str, again: bool = False) -> dict[str, DataFrame] | tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    met = saved(sql(spark, sf_dir, _MET).repartition("id"))  # read by mentions, founders, references and handles
    none = F.array().cast("array<string>").alias("education")
    fields = ["display_name", "city", "company", "occupation", "discovery_confidence"]
    mentions = met.filter("id % 5 = 0").select("id", *fields, none)
    founders = met.filter("id % 5 <> 0").select(F.col("id").cast("string").alias("founder_id"), *fields, none)
    long = lambda rows, key, kinds: rows.select(F.col("id").alias(key), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("raw")) for k in kinds))).alias("x")).select(key, "x.*").filter("raw is not null")
    references = long(met.filter("id % 5 = 0"), "id", ("github", "orcid", "linkedin"))
    held = long(met.filter("id % 5 <> 0"), "founder_id", ("github",)).select(F.col("founder_id").cast("string").alias("founder_id"), "kind", F.col("raw").alias("value"))
    payloads = sql(spark, sf_dir, _PAYLOADS).withColumn("source", F.lit("web")).withColumn("confidence", F.lit(0.7)).withColumn("method", F.lit("research"))
    signals = sql(spark, sf_dir, _STORED)
    now = D.as_of()
    edges = signals.select(F.col("signal_id").cast("string").alias("founder_id"), "signal_id", F.lit(0.6).alias("confidence"), F.lit("legacy").alias("method"), now.alias("attributed_at"))
    reviews = spark.createDataFrame([], "fingerprint string")
    first = N.delivered(mentions, payloads, references, founders, held, signals, edges, reviews, now)
    if not again:
        return first
    # the state as stored tables: the next delivery reads each several times, and would plan and make it anew every time
    first |= {name: saved(first[name]) for name in ("founders", "handles", "signals", "edges", "reviews", "placements")}
    prints = first["reviews"].select("fingerprint")
    signals = signals.withColumn("signal_id", F.col("signal_id").cast("string")).unionByName(first["signals"].select("signal_id", "canonical_url", "content_hash", F.lit("founder").alias("kind")))
    founders = founders.unionByName(first["founders"].select("founder_id", *fields, "education"))
    return first, N.delivered(mentions, payloads, references, founders, held.unionByName(first["handles"]), signals, first["edges"], prints, now, first["placements"])


# Accepted mentions; their pages taken one after another (URL, then content, of what is stored or was made before); mentions
# resolved against the others; then new ones of one identifying handle joined.
_ACCEPTED = f""", met AS ({_MET}), e AS (SELECT * FROM met WHERE id % 5 <> 0), payload AS ({_PAYLOADS}), stored AS ({_STORED}),
    urls AS (SELECT id, pos, canonical_url, content_hash FROM payload WHERE canonical_url IS NOT NULL UNION ALL SELECT DISTINCT id, 1000000, replace(lower(linkedin), 'www.', ''), NULL FROM met WHERE id % 5 = 0 AND linkedin IS NOT NULL),
    i AS (SELECT * FROM met WHERE id % 5 = 0 AND id % 35 <> 0 AND id IN (SELECT id FROM urls)), void AS (SELECT github FROM e WHERE github IS NOT NULL GROUP BY github HAVING count(DISTINCT display_name) > 1),
    page AS (SELECT u.*, a.signal_id AS by_url, b.signal_id AS by_hash FROM urls u SEMI JOIN i USING (id) LEFT JOIN stored a ON a.canonical_url = u.canonical_url LEFT JOIN stored b ON b.content_hash = u.content_hash),
    seq AS (SELECT *, row_number() OVER (ORDER BY id, pos, canonical_url) AS n FROM page WHERE by_url IS NULL AND by_hash IS NULL),
    taken AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS hs, false AS made UNION ALL SELECT n, CASE WHEN made THEN list_append(us, canonical_url) ELSE us END, CASE WHEN made AND content_hash IS NOT NULL THEN list_append(hs, content_hash) ELSE hs END, made
        FROM (SELECT s.n, us, hs, s.canonical_url, s.content_hash, NOT list_contains(us, s.canonical_url) AND NOT coalesce(list_contains(hs, s.content_hash), false) AS made FROM taken t JOIN seq s ON s.n = t.n + 1)),
    made_page AS (SELECT s.* FROM seq s JOIN taken t USING (n) WHERE t.made),
    met_page AS (SELECT p.id, p.pos, p.canonical_url, p.by_url, p.by_hash, c.canonical_url AS new_url, h.canonical_url AS new_hash, c.id = p.id AND c.pos = p.pos AS made FROM page p LEFT JOIN made_page c ON c.canonical_url = p.canonical_url AND (c.id, c.pos) <= (p.id, p.pos) LEFT JOIN made_page h ON h.content_hash = p.content_hash AND (h.id, h.pos) <= (p.id, p.pos)),
    found AS (SELECT id, pos, canonical_url, CASE WHEN by_url IS NOT NULL THEN CAST(by_url AS VARCHAR) WHEN new_url IS NOT NULL THEN 'url-' || substr(sha256(new_url), 1, 24) WHEN by_hash IS NOT NULL THEN CAST(by_hash AS VARCHAR) ELSE 'url-' || substr(sha256(new_hash), 1, 24) END AS signal_id,
        CASE WHEN by_url IS NOT NULL THEN 'url' WHEN made THEN 'new' WHEN new_url IS NOT NULL THEN 'batch_url' WHEN by_hash IS NOT NULL THEN 'hash' ELSE 'batch_hash' END AS matched_by FROM met_page),
    art AS (SELECT DISTINCT f.id AS i_id, s.signal_id AS e_id FROM found f JOIN stored s ON CAST(s.signal_id AS VARCHAR) = f.signal_id),
    pairs AS (SELECT i.id AS i_id, e.id AS e_id, i.display_name = e.display_name AS named, coalesce(i.github = e.github AND i.github NOT IN (SELECT github FROM void), false) AS shared, art.e_id IS NOT NULL AS page,
        coalesce(i.github <> e.github AND i.github NOT IN (SELECT github FROM void) AND e.github NOT IN (SELECT github FROM void), false) AS apart, CAST(i.city = e.city AS INT) + CAST(i.company = e.company AS INT) AS context
        FROM i JOIN e ON true LEFT JOIN art ON art.i_id = i.id AND art.e_id = e.id WHERE i.display_name = e.display_name OR i.github = e.github OR art.e_id IS NOT NULL),
    s AS (SELECT *, (named AND apart AND NOT shared) OR (NOT named AND shared) AS clash, CASE WHEN named AND shared THEN 0.99 WHEN named AND page THEN 0.97 WHEN named AND context >= 2 THEN 0.89 WHEN named THEN 0.7 + 0.1 * context END AS score FROM pairs WHERE named OR shared),
    best AS (SELECT i_id, arg_min(e_id, (-score, CAST(e_id AS VARCHAR))) AS e_id, max(score) AS score, arg_min(shared, (-score, CAST(e_id AS VARCHAR))) AS shared FROM s WHERE NOT clash GROUP BY i_id), worst AS (SELECT i_id, min(CAST(e_id AS VARCHAR)) AS e_id FROM s WHERE clash GROUP BY i_id),
    dec AS (SELECT i.*, CASE WHEN best.score >= 0.9 AND best.shared THEN 'exact_key' WHEN best.score >= 0.9 THEN 'artifact' WHEN best.score IS NOT NULL THEN 'review' WHEN worst.e_id IS NOT NULL THEN 'conflict' ELSE 'new' END AS method, best.e_id AS best_id, worst.e_id AS worst_id FROM i LEFT JOIN best ON best.i_id = i.id LEFT JOIN worst ON worst.i_id = i.id),
    made AS (SELECT id, min(id) OVER (PARTITION BY github) AS canon FROM dec WHERE method = 'new' AND github NOT IN (SELECT github FROM dec WHERE method = 'new' GROUP BY github HAVING count(DISTINCT display_name) > 1)),
    placed AS (SELECT dec.id, CASE WHEN method IN ('new', 'conflict') THEN 'new-' || substr(sha256(CAST(coalesce(made.canon, dec.id) AS VARCHAR)), 1, 16) ELSE CAST(best_id AS VARCHAR) END AS founder_id, method IN ('new', 'conflict') AS created, method IN ('review', 'conflict') AS flagged, method, CASE WHEN method = 'conflict' THEN CAST(worst_id AS VARCHAR) END AS counterpart_id, github, orcid FROM dec LEFT JOIN made ON made.id = dec.id)"""
_WITH = "WITH RECURSIVE one AS (SELECT 1)"


@query(f"{_WITH}{_ACCEPTED} SELECT id, founder_id, created, flagged, method, counterpart_id FROM placed")
def delivery_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose each delivered mention is: gates, evidence, resolution, and new people that are one."""
    return _delivery(spark, sf_dir)["placed"].select("id", "founder_id", "created", "flagged", "method", "counterpart_id")


_HOLDS = "SELECT DISTINCT founder_id, 'github' AS kind, github AS value FROM placed WHERE github IS NOT NULL UNION SELECT founder_id, 'orcid', orcid FROM (SELECT founder_id, orcid, row_number() OVER (PARTITION BY orcid ORDER BY id) AS n, first_value(founder_id) OVER (PARTITION BY orcid ORDER BY id) AS holder FROM placed WHERE orcid = '0000-0002-1825-0097') WHERE founder_id = holder"


@query(f"{_WITH}{_ACCEPTED}, holds AS ({_HOLDS}) SELECT h.founder_id, h.kind, h.value FROM holds h LEFT JOIN e ON CAST(e.id AS VARCHAR) = h.founder_id AND e.github = h.value WHERE e.id IS NULL")
def delivery_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles that the delivery adds: those that founders lack, an ORCID only to the first who has it."""
    return _delivery(spark, sf_dir)["handles"]


@query(
    f"""{_WITH}{_ACCEPTED}, per AS (SELECT id, signal_id, arg_min(CASE WHEN contains(canonical_url, 'linkedin') THEN -1 ELSE 0.7 END, (pos, canonical_url)) AS confidence FROM found GROUP BY id, signal_id)
    SELECT founder_id, signal_id, max(CASE WHEN confidence >= 0 THEN confidence END) AS confidence FROM (SELECT p.founder_id, f.signal_id, f.confidence FROM placed p JOIN per f USING (id) UNION ALL SELECT CAST(signal_id AS VARCHAR), CAST(signal_id AS VARCHAR), 0.6 FROM stored) GROUP BY founder_id, signal_id"""
)
def delivery_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution edges after the delivery: new ones, and old ones whose confidence rose."""
    return _delivery(spark, sf_dir)["edges"].select("founder_id", "signal_id", "confidence")


@query(
    f"""{_WITH}{_ACCEPTED}, holds AS ({_HOLDS}) SELECT 'new_founders' AS metric, count(DISTINCT founder_id) AS n FROM placed WHERE created UNION ALL SELECT 'resolved_to_existing', count(*) FROM placed WHERE NOT created UNION ALL SELECT 'new_signals', count(*) FROM made_page
    UNION ALL SELECT 'new_handles', count(*) FROM holds h LEFT JOIN e ON CAST(e.id AS VARCHAR) = h.founder_id AND e.github = h.value WHERE e.id IS NULL UNION ALL SELECT 'withheld', count(DISTINCT founder_id) - count(DISTINCT orcid) FROM placed WHERE orcid = '0000-0002-1825-0097'
    UNION ALL SELECT 'reviews', count(*) FROM (SELECT DISTINCT m.display_name, m.city, m.company, m.github, m.orcid = '0000-0002-1825-0097' FROM placed p JOIN met m USING (id) WHERE flagged)
    UNION ALL SELECT CASE WHEN id % 35 = 0 THEN 'dropped_not_a_person' ELSE 'dropped_no_evidence' END, count(*) FROM met WHERE id % 5 = 0 AND (id % 35 = 0 OR id NOT IN (SELECT id FROM urls)) GROUP BY 1
    UNION ALL SELECT 'identity:orcid:checksum', count(*) FROM met WHERE id % 5 = 0 AND orcid = '0000-0002-1825-0098' HAVING count(*) > 0"""
)
def delivery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delivery did, by metric."""
    return N.summary(_delivery(spark, sf_dir))


@query(f"{_WITH}{_ACCEPTED} SELECT id, min(matched_by) AS matched_by, signal_id FROM found WHERE pos = 0 GROUP BY id, signal_id")
def delivered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signal each delivered page is: a stored one or one that an earlier page of the delivery made, by URL or by content,
    else its own."""
    return _delivery(spark, sf_dir)["found"].filter("pos = 0").select("id", "matched_by", "signal_id")


@query("SELECT 'founders' AS what, 0 AS n UNION ALL SELECT 'moved', 0 UNION ALL SELECT 'handles', 0 UNION ALL SELECT 'reviews', 0 UNION ALL SELECT 'signals', 0")
def delivery_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same delivery again on what it left: nothing is added, and no mention changes its founder."""
    first, again = _delivery(spark, sf_dir, again=True)
    was = first["placed"].select("id", F.col("founder_id").alias("was"))
    again["moved"] = again["placed"].join(was, "id", "full").filter(~F.col("founder_id").eqNullSafe(F.col("was")))
    out = None
    for name in ("founders", "moved", "handles", "reviews", "signals"):
        one = again[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Names of letters from a hash, so that only the planted ones are alike: every third customer is met again with a letter less.
_NAMED = "SELECT c_custkey AS id, 'An' || translate(substr(md5('f' || c_custkey), 1, 12), '0123456789', 'ghijklmnop') || ' Von' || translate(substr(md5('l' || c_custkey), 1, 14), '0123456789', 'ghijklmnop') AS display_name, 'city ' || c_nationkey AS city, lower(c_mktsegment) AS company FROM customer"
_AGAIN = f"SELECT id + 10000000 AS id, substr(display_name, 1, 20) || substr(display_name, 22) AS display_name, CASE WHEN id % 2 = 0 THEN city ELSE 'elsewhere' END AS city, CASE WHEN id % 4 < 2 THEN company ELSE 'other' END AS company FROM ({_NAMED}) WHERE id % 3 = 0"


@query(
    f"""SELECT a.id, 'review' AS decision, 'review' AS method, n.id AS matched_id, round(CASE WHEN (a.city = n.city) AND (a.company = n.company) THEN 0.89 ELSE least(0.89, 2.0 * length(a.display_name) / (length(a.display_name) + length(n.display_name)) * 0.7 + 0.1 * (CAST(a.city = n.city AS INT) + CAST(a.company = n.company AS INT))) END, 3) AS confidence
    FROM ({_AGAIN}) a JOIN ({_NAMED}) n ON n.id = a.id - 10000000"""
)
def near_named_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People met again under a name with a letter less: the same name to the resolver, so a case for review."""
    none = F.array().cast("array<string>").alias("education")
    known, met = (sql(spark, sf_dir, q).select("*", none) for q in (_NAMED, _AGAIN))
    handles = spark.createDataFrame([], "id long, kind string, value string")
    return R.resolved(met, known, handles, handles).select("id", "decision", "method", "matched_id", "confidence")


_TWICE = f"SELECT id + 10000000 AS id, display_name, CASE WHEN id % 2 = 0 THEN city ELSE 'elsewhere' END AS city, CASE WHEN id % 4 < 2 THEN company ELSE 'other' END AS company FROM ({_NAMED}) WHERE id % 3 = 0"


@query(
    f"""SELECT a.id - 10000000 AS left_id, a.id AS right_id, 'review' AS decision, round(CAST(CASE WHEN (a.city = n.city) AND (a.company = n.company) THEN 0.89 ELSE 0.7 + 0.1 * (CAST(a.city = n.city AS INT) + CAST(a.company = n.company AS INT)) END AS DOUBLE), 3) AS confidence
    FROM ({_TWICE}) a JOIN ({_NAMED}) n ON n.id = a.id - 10000000
    UNION ALL SELECT a.id - 10000000, a.id + 10000000, 'review', round(CASE WHEN (a.city = n.city) AND (a.company = n.company) THEN 0.89 ELSE least(0.89, 2.0 * length(a.display_name) / (length(a.display_name) + length(n.display_name)) * 0.7 + 0.1 * (CAST(a.city = n.city AS INT) + CAST(a.company = n.company AS INT))) END, 3)
    FROM ({_AGAIN}) a JOIN ({_NAMED}) n ON n.id = a.id - 10000000"""
)
def open_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs a merge run leaves for a human, over everyone: one name without a handle that decides, and near names that share
    a handle. Those met again a letter short hold the handle of one namesake; with the other they make no pair of the sweep."""
    none = F.array().cast("array<string>").alias("education")
    short = sql(spark, sf_dir, _AGAIN).withColumn("id", F.col("id") + 10000000)
    people = sql(spark, sf_dir, _NAMED).unionByName(sql(spark, sf_dir, _TWICE)).unionByName(short).select("*", none)
    value = F.concat(F.lit("h"), (F.col("id") % 10000000).cast("string")).alias("value")
    handles = people.filter("id < 10000000 or id >= 20000000").select("id", F.lit("github").alias("kind"), value)
    return C.reconciled(people, handles, strangers=True)[1].select("left_id", "right_id", "decision", "confidence")


# Every customer as three people of one name (of three, in the last case), with what they hold: rows of (person, kind, value).
# 0: 1 and 2 share a handle, 2 and 3 a page, 1 and 3 disagree on ORCID; 1: a page joins 1 and 2 before a handle joins 3, who
# disagrees with 1; 2: a chain of handles; 3: a page of 1 and 2, who disagree; 4: a page of all; 5: a handle of strangers.
_TRIOS = f"SELECT n.id * 10 + m AS id, CASE WHEN n.id % 6 = 5 THEN display_name || substr('xyz', CAST(m AS INT), 1) || 'qqq' ELSE display_name END AS display_name, city, company FROM ({_NAMED}) n, (VALUES (1), (2), (3)) t(m)"
_HOLD = """SELECT c_custkey * 10 + m AS id, kind, value || c_custkey AS value FROM customer JOIN (VALUES (0, 1, 'github', 'a'), (0, 2, 'github', 'a'), (0, 1, 'orcid', 'o'), (0, 3, 'orcid', 'p'), (0, 2, 'page', 'u'), (0, 3, 'page', 'u'),
    (1, 1, 'twitter', 's'), (1, 2, 'github', 'b'), (1, 3, 'github', 'b'), (1, 3, 'twitter', 't'), (1, 1, 'page', 'u'), (1, 2, 'page', 'u'), (2, 1, 'github', 'c'), (2, 2, 'github', 'c'), (2, 2, 'linkedin', 'l'), (2, 3, 'linkedin', 'l'),
    (3, 1, 'github', 'd'), (3, 2, 'github', 'e'), (3, 1, 'page', 'u'), (3, 2, 'page', 'u'), (4, 1, 'page', 'u'), (4, 2, 'page', 'u'), (4, 3, 'page', 'u'), (5, 1, 'github', 'f'), (5, 2, 'github', 'f'), (5, 3, 'github', 'f')) h(trio, m, kind, value) ON trio = c_custkey % 6"""
# What the reference's loop over pairs leaves of each case.
_OUTCOME = """(VALUES (0, 1, 2, 'merge', 0.99), (0, 1, 3, 'conflict', 0.0), (1, 1, 2, 'merge', 0.97), (1, 1, 3, 'merge', 0.99), (2, 1, 2, 'merge', 0.99), (2, 1, 3, 'merge', 0.99), (3, 1, 2, 'conflict', 0.0), (3, 1, 3, 'review', 0.89), (3, 2, 3, 'review', 0.89),
    (4, 1, 2, 'merge', 0.97), (4, 1, 3, 'merge', 0.97)) o(trio, l, r, decision, confidence)"""


def _trios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = F.array().cast("array<string>").alias("education")
    held = sql(spark, sf_dir, _HOLD)
    return sql(spark, sf_dir, _TRIOS).select("*", none), held.filter("kind <> 'page'"), held.filter("kind = 'page'").select("id", F.col("value").alias("url"))


@query(f"SELECT c_custkey * 10 + l AS left_id, c_custkey * 10 + r AS right_id, decision, CAST(confidence AS DOUBLE) AS confidence FROM customer JOIN {_OUTCOME} ON trio = c_custkey % 6")
def reconciled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge run over clusters of three with disagreements: merges in order, and what is left for a human."""
    merged, pairs = C.reconciled(*_trios(spark, sf_dir))
    confidence = F.when(F.col("by") == "handle", R.BY_HANDLE).otherwise(R.BY_ARTIFACT)
    done = merged.filter("id <> canonical").select(F.col("canonical").alias("left_id"), F.col("id").alias("right_id"), F.lit("merge").alias("decision"), confidence.alias("confidence"))
    return done.unionByName(pairs.select("left_id", "right_id", "decision", "confidence"))


@query(
    f"""WITH o AS (SELECT decision FROM customer JOIN {_OUTCOME} ON trio = c_custkey % 6), dry AS (SELECT decision FROM customer JOIN (VALUES (0, 'merge'), (0, 'merge'), (0, 'conflict'), (1, 'merge'), (1, 'merge'), (1, 'conflict'), (2, 'merge'), (2, 'merge'), (2, 'review'), (3, 'conflict'), (3, 'review'), (3, 'review'), (4, 'merge'), (4, 'merge'), (4, 'merge')) d(trio, decision) ON trio = c_custkey % 6)
    SELECT run, metric, (SELECT count(*) FROM o WHERE run = 'run' AND decision || 's' = metric) + (SELECT count(*) FROM dry WHERE run = 'dry' AND decision || 's' = metric) AS n FROM (VALUES ('run'), ('dry')) r(run), (VALUES ('merges'), ('reviews'), ('conflicts')) m(metric)"""
)
def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a merge run and of a dry one, which lists pairs as they stand."""
    real, dry = (C.report(*C.reconciled(*_trios(spark, sf_dir), dry_run=x)) for x in (False, True))
    return real.select(F.lit("run").alias("run"), "*").unionByName(dry.select(F.lit("dry").alias("run"), "*"))


@query("SELECT c_custkey AS founder_id, 'github' AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey ELSE 'page' || c_nationkey END AS value FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def first_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reference that identifies a person: their own, else that of an artifact."""
    n = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer")
    own = rows.select(n.alias("founder_id"), F.lit("github").alias("kind"), F.when(n % 3 == 0, F.concat(F.lit("@Own"), n.cast("string"))).otherwise("https://github.com/orgs/x").alias("raw"))
    urls = rows.filter("c_custkey % 2 = 0").select(n.alias("founder_id"), F.posexplode(F.array(F.lit("https://e.test/github.com/no"), F.concat(F.lit("https://github.com/Page"), F.col("c_nationkey").cast("string"), F.lit("/repo")), F.lit("https://github.com/later"))).alias("pos", "url"))
    return V.first_identities(own, urls)


_DEALS = "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE o_custkey END AS founder_id, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'Supplier ' || (o_orderkey % 9) || CASE WHEN o_orderkey % 2 = 0 THEN ' GmbH' ELSE '' END END AS company_name, CASE WHEN o_orderkey % 3 = 0 THEN 'an idea' END AS idea, CASE WHEN o_orderkey % 5 <> 0 THEN ' ' || lower(o_orderpriority) ELSE ' ' END AS sector, 'DE' AS geo FROM orders"
_COMPANIES = "SELECT s_suppkey AS company_id, 'supplier ' || s_suppkey AS name_key, CAST(NULL AS VARCHAR) AS domain FROM supplier WHERE s_suppkey % 2 = 0"


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    founders = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("founder_id"))
    return N.opened_deals(sql(spark, sf_dir, _DEALS), founders, D.signals(spark, sf_dir), sql(spark, sf_dir, _COMPANIES), D.as_of())


@query(
    D.with_views(
        "signal",
        sql=f""", r AS ({_DEALS}), c AS ({_COMPANIES}), f AS (SELECT founder_id, min(coalesce(occurred_at, ingested_at)) AS first_at FROM signal GROUP BY founder_id)
        SELECT request_id, r.founder_id, nullif(trim(company_name), '') AS company_name, CASE WHEN trim(company_name) <> '' THEN coalesce(CAST(company_id AS VARCHAR), 'new-' || substr(sha256('supplier ' || (request_id % 9)), 1, 16)) END AS company_id, idea, nullif(trim(sector), '') AS sector, strftime(coalesce(first_at, TIMESTAMP '2001-08-01'), '%Y-%m-%d %H:%M:%S') AS first_signal_at
        FROM r JOIN customer ON c_custkey = r.founder_id LEFT JOIN c ON c.name_key = 'supplier ' || (request_id % 9) AND trim(company_name) <> '' LEFT JOIN f ON f.founder_id = r.founder_id WHERE idea IS NOT NULL OR trim(sector) <> ''""",
    )
)
def opened_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals opened by hand: a known founder, a subject, the company of the name, and the clock since the first signal."""
    deals, _ = _opened(spark, sf_dir)
    return deals.select("request_id", "founder_id", "company_name", "company_id", "idea", "sector", F.date_format("first_signal_at", "yyyy-MM-dd HH:mm:ss").alias("first_signal_at"))


@query(f"SELECT request_id, CASE WHEN c_custkey IS NULL THEN 'unknown_founder' ELSE 'no_subject' END AS reason FROM ({_DEALS}) LEFT JOIN customer ON c_custkey = founder_id WHERE c_custkey IS NULL OR (idea IS NULL AND trim(sector) = '')")
def refused_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir)[1].select("request_id", "reason")


# Conversations as decks: turns are pages, what assistants say are claims that cite a page, which may not be there.
_DECKS = "SELECT DISTINCT conv_id AS deck_id, CASE WHEN conv_id % 17 = 0 THEN ' ' ELSE 'Supplier ' || (conv_id % 9) END AS company_name, 'idea' AS idea, CASE WHEN conv_id % 3 = 0 THEN 'gambling' ELSE 'Health Tech' END AS sector, 'DE' AS geo FROM conversations"
_PAGES = "SELECT conv_id AS deck_id, 'c' AS company, turn AS page, CASE WHEN conv_id % 13 = 0 THEN ' ' ELSE text END AS text FROM conversations"
_NAMES = "SELECT DISTINCT conv_id AS deck_id, 1 AS pos, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 'Ada Number' || translate(substr(md5(CAST(conv_id % 40 AS VARCHAR)), 1, 9), '0123456789', 'ghijklmnop') END AS name, 'CEO' AS role, 'https://www.linkedin.com/in/In-' || (conv_id % 40) AS linkedin FROM conversations"
_SAID = "SELECT conv_id AS deck_id, turn AS claim_no, 'traction' AS category, text AS statement, CASE WHEN turn % 3 = 0 THEN turn + 100 ELSE turn END AS source_page FROM conversations WHERE role = 'assistant'"


def _inbound(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    decks, pages, names, said, companies = (sql(spark, sf_dir, q) for q in (_DECKS, _PAGES, _NAMES, _SAID, _COMPANIES))
    known = sql(spark, sf_dir, "SELECT CAST(k AS VARCHAR) AS founder_id, k, 'Ada Number' || translate(substr(md5(CAST(k AS VARCHAR)), 1, 9), '0123456789', 'ghijklmnop') AS display_name FROM (SELECT DISTINCT c_custkey % 20 AS k FROM customer)")
    founders = known.select("founder_id", "display_name", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("company"), F.array().cast("array<string>").alias("education"))
    held = known.select("founder_id", F.lit("linkedin").alias("kind"), F.concat(F.lit("in-"), F.col("k").cast("string")).alias("value"))
    return N.inbound(decks, pages, names, said, founders, held, companies, F.array(F.lit("HealthTech"), F.lit("health tech")), D.as_of())


_GOOD = f"d AS ({_DECKS}), n AS ({_NAMES}), g AS (SELECT d.*, deck_id % 40 AS k FROM d JOIN n USING (deck_id) WHERE trim(company_name) <> '' AND name IS NOT NULL AND deck_id IN (SELECT conv_id FROM conversations WHERE conv_id % 13 <> 0 AND trim(coalesce(text, '')) <> ''))"


@query(
    f"""WITH {_GOOD}, c AS ({_COMPANIES}), s AS ({_SAID}), m AS (SELECT s.deck_id, count(*) FILTER (WHERE p.conv_id IS NOT NULL AND trim(coalesce(statement, '')) <> '') AS minted, count(*) AS n FROM s LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = deck_id AND p.turn = source_page GROUP BY s.deck_id)
    SELECT CAST(g.deck_id AS VARCHAR) AS deck_id, CASE WHEN k < 20 THEN CAST(k AS VARCHAR) ELSE 'new-' || substr(sha256(min(CAST(g.deck_id AS VARCHAR)) OVER (PARTITION BY k)), 1, 16) END AS founder_id, coalesce(CAST(company_id AS VARCHAR), 'new-' || substr(sha256('supplier ' || (g.deck_id % 9)), 1, 16)) AS company_id, CASE WHEN g.deck_id % 3 = 0 THEN 'rejected' ELSE 'screening' END AS status, coalesce(minted, 0) AS claims_minted, coalesce(n - minted, 0) AS claims_dropped
    FROM g LEFT JOIN c ON name_key = 'supplier ' || (g.deck_id % 9) LEFT JOIN m ON m.deck_id = g.deck_id"""
)
def inbound_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by deck become deals: founder and company resolved, claims cited to pages, the thesis applied."""
    return _inbound(spark, sf_dir)["deals"].select("deck_id", "founder_id", "company_id", "status", "claims_minted", "claims_dropped")


@query(f"WITH {_GOOD} SELECT CAST(g.deck_id AS VARCHAR) AS deck_id, s.claim_no, CAST(0.34 AS DOUBLE) AS trust, 'unverified' AS status, 'deck p.' || source_page AS source_pointer FROM ({_SAID}) s JOIN g ON g.deck_id = s.deck_id JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON p.conv_id = s.deck_id AND p.turn = source_page WHERE trim(coalesce(statement, '')) <> ''")
def deck_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decks assert, on the pages that say so."""
    return _inbound(spark, sf_dir)["claims"].select("deck_id", "claim_no", "trust", "status", "source_pointer")


@query(f"SELECT deck_id, coalesce(string_agg('[deck p.' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page, text) FILTER (WHERE text <> ''), '(no deck text)') AS block, count(*) FILTER (WHERE text <> '') AS n_pages FROM ({_PAGES}) GROUP BY deck_id")
def deck_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.page_blocks(sql(spark, sf_dir, _PAGES))


@query("SELECT name, min(pos) AS pos FROM (SELECT p_name AS name, p_partkey AS pos FROM part) WHERE name NOT IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0) GROUP BY name ORDER BY pos LIMIT 35")
def unmet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a network hop that nobody known bears the name of: the run's first thirty-five."""
    part = D.table(spark, sf_dir, "part")
    return N.unmet(part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos")), part.filter("p_partkey % 97 = 0").select(F.upper("p_name").alias("display_name"))).select("name", "pos")


_REVIEWED = "SELECT p_partkey AS id, p_name AS display_name, p_size AS city FROM part"


@query("SELECT count(DISTINCT (display_name, city, company, github)) AS fingerprints, count(*) AS mentions FROM (SELECT p_name AS display_name, p_size % 10 AS city, lower(p_type) AS company, lower(replace(p_brand, '#', '-')) || '-' || p_size AS github FROM part)")
def review_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different cases all mentions are: replays share a fingerprint, whatever their spelling."""
    rows = D.mentions(spark, sf_dir)
    people = rows.select(F.col("mention_id").alias("id"), F.when(F.col("mention_id") % 2 == 0, F.upper("display_name")).otherwise(F.concat(F.lit("Dr. "), "display_name")).alias("display_name"), "city", F.upper("company").alias("company"))
    handles = rows.select(F.col("mention_id").alias("id"), F.lit("github").alias("kind"), F.col("github").alias("value"))
    return R.review_fingerprint(people, handles).agg(F.count_distinct("fingerprint").alias("fingerprints"), F.count("*").alias("mentions"))


# ---- pages, searches, institutions, clean-up ---------------------------------------------------------------------------------

_OWN = "SELECT c_custkey AS founder_id, c_custkey * 10 + k AS identity_id, CASE WHEN k = 0 THEN 'gh' || c_custkey END AS github, CASE WHEN k = 1 OR c_custkey % 3 = 0 THEN 'in' || c_custkey END AS linkedin, CAST(NULL AS VARCHAR) AS twitter, CASE WHEN c_custkey % 7 = 0 THEN 'https://e.test/' || c_custkey END AS website FROM customer, (SELECT 0 AS k UNION ALL SELECT 1)"


@query(
    D.with_views(
        "founder", "signal", "claim", "raw_evidence", "evidence", "trust", "score_point",
        sql=f""", own AS ({_OWN}), f1 AS (SELECT * FROM own WHERE identity_id % 10 = 0), n AS (SELECT claim_id, count(*) AS n, count(*) FILTER (WHERE stance = 'supports') AS s, count(*) FILTER (WHERE stance = 'refutes') AS r FROM evidence GROUP BY claim_id)
        SELECT founder_id, 'identity' AS part, 1 AS position, 'github:' || github AS label, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS at FROM f1 UNION ALL SELECT founder_id, 'identity', 3, 'linkedin:' || linkedin, NULL, NULL FROM f1 WHERE linkedin IS NOT NULL UNION ALL SELECT founder_id, 'identity', 4, 'website:' || website, NULL, NULL FROM f1 WHERE website IS NOT NULL
        UNION ALL SELECT founder_id, 'signal', row_number() OVER (PARTITION BY founder_id ORDER BY occurred_at ASC NULLS LAST, signal_id), signal_id || ':' || source || CASE WHEN signal_id % 3 = 0 THEN '' ELSE ':research' END, round(0.5 + (signal_id % 5) / 10.0, 1), strftime(occurred_at, '%Y-%m-%d %H:%M:%S') FROM signal JOIN founder USING (founder_id)
        UNION ALL SELECT founder_id, 'claim', row_number() OVER (PARTITION BY founder_id ORDER BY trust DESC NULLS LAST, claim_id), claim_id || CASE WHEN status IS NULL THEN '' ELSE ':' || status END || ':' || coalesce(n, 0) || ':' || coalesce(s, 0) || ':' || coalesce(r, 0), trust, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') FROM claim LEFT JOIN trust USING (claim_id) LEFT JOIN n USING (claim_id) JOIN (SELECT founder_id FROM founder) USING (founder_id)
        UNION ALL SELECT founder_id, 'score', row_number() OVER (PARTITION BY founder_id ORDER BY created_at, point_id), '', score, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM score_point JOIN (SELECT founder_id FROM founder) USING (founder_id)""",
    )
)
def founder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of every founder's page: identity, timeline with attribution, claims by trust, score history."""
    from ..operators import claims as C

    s = D.signals(spark, sf_dir)
    edges = s.select("founder_id", "signal_id", F.round(0.5 + (F.col("signal_id") % 5) / 10, 1).alias("confidence"), F.when(F.col("signal_id") % 3 != 0, "research").alias("method"))
    evidence = C.fold_evidence(D.raw_evidence(spark, sf_dir))
    claims = D.claims(spark, sf_dir).join(C.trust(evidence).select("claim_id", "trust", "status"), "claim_id", "left").select("founder_id", "claim_id", "trust", "status", F.col("occurred_at").alias("updated_at"))
    out = W.founder_pages(D.founders(spark, sf_dir), sql(spark, sf_dir, _OWN), s, edges, claims, evidence, D.score_points(spark, sf_dir))
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    D.with_views(
        "founder", "claim",
        sql="""SELECT f.founder_id, '[' || f.founder_id || '] ' || display_name || ' | ' || occupation || ' @ ' || CASE WHEN f.founder_id % 2 = 0 THEN 'Co ' || f.founder_id ELSE 'no company' END || ' | city=' || coalesce(city, '?') || ' | FounderScore=None | claims: ' || coalesce(c, 'none') AS line FROM founder f
        LEFT JOIN (SELECT founder_id, string_agg(category || ' ' || claim_id, '; ' ORDER BY n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY founder_id ORDER BY impact DESC NULLS LAST, claim_id) AS n FROM claim) WHERE n <= 15 GROUP BY founder_id) USING (founder_id)""",
    )
)
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a founder search reads, a line a founder."""
    founders = D.founders(spark, sf_dir).withColumn("current_company", F.when(F.col("founder_id") % 2 == 0, F.concat(F.lit("Co "), F.col("founder_id").cast("string")))).withColumn("founder_score", F.lit(None).cast("double"))
    claims = D.claims(spark, sf_dir).withColumn("statement", F.concat_ws(" ", "category", F.col("claim_id").cast("string"))).withColumn("trust", F.col("impact"))
    return W.search_lines(founders, claims)


@query(D.with_views("founder", sql="SELECT founder_id, display_name, city, relevance FROM (SELECT o_orderkey % 4000 AS founder_id, round(o_totalprice / 600000, 4) AS relevance FROM orders) JOIN founder USING (founder_id)"))
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search returned, without the ids that do not exist."""
    returned = D.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("founder_id"), F.round(F.col("o_totalprice") / 600000, 4).alias("relevance"), F.lit("fits").alias("reason"))
    return W.search_matches(returned, D.founders(spark, sf_dir).withColumn("founder_score", F.lit(None).cast("double"))).select("founder_id", "display_name", "city", "relevance")


_STUDIED = "SELECT o_custkey AS founder_id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN 'The University of N' || (o_orderkey % 25) ELSE 'University N' || (o_orderkey % 25) || ' (UN)' END AS school FROM orders"
_ALIASES = "SELECT 'university n' || n_nationkey AS alias_key, CASE WHEN n_nationkey % 3 <> 0 THEN 'ror' || (n_nationkey % 13) END AS ror_id FROM nation"


@query(f"SELECT trim(school) AS school, count(*) AS n FROM ({_STUDIED}) WHERE trim(school) <> '' GROUP BY 1")
def affiliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.institution_counts(sql(spark, sf_dir, _STUDIED), sql(spark, sf_dir, _ALIASES))[0]


@query(f"SELECT ror_id, count(*) AS n FROM ({_STUDIED}) JOIN ({_ALIASES}) ON alias_key = 'university n' || regexp_extract(school, ' N([0-9]+)', 1) WHERE trim(school) <> '' AND ror_id IS NOT NULL GROUP BY ror_id ORDER BY n DESC, ror_id LIMIT 10")
def top_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten institutions most founders share."""
    return V.institution_counts(sql(spark, sf_dir, _STUDIED), sql(spark, sf_dir, _ALIASES))[1]


@query(f"SELECT 'university n' || k AS alias_key, CASE WHEN k >= 10 AND k % 4 <> 0 THEN 'new' || k END AS ror_id FROM (SELECT DISTINCT CAST(regexp_extract(school, ' N([0-9]+)', 1) AS INT) AS k FROM ({_STUDIED}) WHERE trim(school) <> '') WHERE k >= 10")
def looked_up_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of the institution cache, misses included: only keys that it lacked."""
    strings = sql(spark, sf_dir, _STUDIED).select(F.col("school").alias("raw_name"))
    cache = sql(spark, sf_dir, _ALIASES).filter("cast(regexp_extract(alias_key, '([0-9]+)', 1) as int) < 10")
    registry = D.table(spark, sf_dir, "nation").select(F.concat(F.lit("university n"), F.col("n_nationkey").cast("string")).alias("alias_key"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("ror_id"), (F.col("n_nationkey") % 4 != 0).alias("chosen"))
    return V.cached_institutions(strings, cache, registry)[1]


_FOLK = "SELECT c_custkey AS founder_id, CASE WHEN c_custkey % 19 = 0 THEN 'Acme Ventures' ELSE 'Ada ' || translate(substr(md5(CAST(c_custkey % 900 AS VARCHAR)), 1, 9), '0123456789', 'ghijklmnop') END AS display_name FROM customer"


@query(
    D.with_views(
        "signal",
        sql=f""", p AS ({_FOLK}), l AS (SELECT * FROM p WHERE founder_id % 19 <> 0), m AS (SELECT a.founder_id AS id, a.founder_id % 900 AS canonical FROM l a JOIN l b ON b.founder_id = a.founder_id % 900 WHERE a.founder_id >= 900),
        k AS (SELECT * FROM l WHERE founder_id NOT IN (SELECT id FROM m)), e AS (SELECT DISTINCT coalesce(m.canonical, s.founder_id) AS founder_id, signal_id FROM signal s LEFT JOIN m ON m.id = s.founder_id WHERE signal_id % 4 = 0 AND (s.founder_id NOT IN (SELECT founder_id FROM p WHERE founder_id % 19 = 0))),
        r AS (SELECT * FROM k WHERE founder_id IN (SELECT founder_id FROM e))
        SELECT 'non_persons' AS metric, count(*) AS n FROM p WHERE founder_id % 19 = 0 UNION ALL SELECT 'merged', count(*) FROM m UNION ALL SELECT 'without_signals', count(*) FROM k WHERE founder_id NOT IN (SELECT founder_id FROM e)
        UNION ALL SELECT 'orphaned_signals', count(*) FROM signal WHERE signal_id NOT IN (SELECT signal_id FROM e) AND signal_id % 10 <> 0 AND signal_id % 7 <> 0 UNION ALL SELECT 'deals_without_founder', count(*) FROM orders WHERE o_orderkey % 101 = 0
        UNION ALL SELECT 'duplicate_groups_before', count(*) FROM (SELECT 1 FROM p GROUP BY display_name HAVING count(*) > 1) UNION ALL SELECT 'remaining_founders', count(*) FROM r UNION ALL SELECT 'duplicate_groups_left', count(*) FROM (SELECT 1 FROM r GROUP BY display_name HAVING count(*) > 1)""",
    )
)
def cleanup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up would take out, and what it leaves."""
    people, s = sql(spark, sf_dir, _FOLK), D.signals(spark, sf_dir)
    canonical = people.filter("founder_id >= 900").select(F.col("founder_id").alias("id"), (F.col("founder_id") % 900).alias("canonical"))
    signals = s.select("signal_id", F.when(F.col("signal_id") % 10 == 0, "market").otherwise("founder").alias("kind"))
    deals = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("opportunity_id"), F.when(F.col("o_orderkey") % 101 != 0, F.col("o_custkey")).alias("founder_id"))
    return V.cleanup(people, canonical, s.filter("signal_id % 4 = 0").select("founder_id", "signal_id"), signals, s.filter("signal_id % 7 = 0").select("signal_id"), deals)[1]
