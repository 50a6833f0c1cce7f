"""Claims, resolution, merging, screening, ingestion and streaming on small tables."""

from datetime import datetime

from pyspark.sql import functions as F

from scoutlake.functions import scoring as S
from scoutlake.operators import claims as C
from scoutlake.operators import delivery, graph, ingest, merge, places, resolve, screening, views
from scoutlake.sources import readers
from scoutlake.streaming import signals as stream


def test_evidence_weight(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.9, 0.9, 0.85), (None, None, None)], "a double, b double, c double")
    assert [round(r[0], 6) for r in df.select(S.evidence_weight(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1.0, 0.6885, 0.224]


def evidence(spark, *edges):
    return spark.createDataFrame(list(edges), "claim_id int, signal_id int, stance string, weight double, source string")


def test_trust_and_status(spark):
    rows = C.trust(evidence(spark, (1, 1, "supports", 0.9, "a"), (2, 1, "supports", 0.5, "a"), (2, 2, "supports", 0.5, "b"), (2, 3, "supports", 0.5, "a"), (3, 1, "supports", 0.9, "a"), (3, 2, "refutes", 0.9, "b"), (4, 1, "supports", None, "a")))
    got = {r["claim_id"]: (r["trust"], r["status"], r["sources"]) for r in rows.collect()}
    assert got[1][:2] == (0.9, "verified") and got[2] == (0.875, "verified", "a,b") and got[3][:2] == (0.09, "contradicted") and got[4][:2] == (0.0, "unverified")


def test_duplicates_do_not_raise_trust(spark):
    raw = spark.createDataFrame([(1, 1, "supports", 0.6, 1.0, 1.0, "a"), (1, 1, "supports", 0.6, 1.0, 1.0, "a")], "claim_id int, signal_id int, stance string, reliability double, confidence double, relevance double, source string")
    assert C.trust(C.fold_evidence(raw)).first()["trust"] == 0.6


def test_recency_and_saturation(spark):
    as_of = F.lit("2026-01-01").cast("timestamp")
    df = spark.createDataFrame([(None,), (datetime(2026, 6, 1),), (datetime(2024, 7, 10),)], "at timestamp")
    assert [round(r[0], 4) for r in df.select(S.recency(F.col("at"), as_of)).collect()] == [0.6, 1.0, 0.5]
    strong = [(1, i, "research", 0.95, 1.0) for i in range(3)] + [(2, 10 + i, "media", 0.1, 0.2) for i in range(30)]
    claims = spark.createDataFrame([(f, c, k, i, None) for f, c, k, _, i in strong], "founder_id int, claim_id int, category string, impact double, occurred_at timestamp")
    trust = spark.createDataFrame([(c, t, "verified") for _, c, _, t, _ in strong], "claim_id int, trust double, status string")
    score = {r["founder_id"]: r["founder_score"] for r in C.founder_scores(C.contributions(claims, trust, as_of)).collect()}
    assert 0 <= score[2] < score[1] <= 100


def test_merge_edges_refutation_wins(spark):
    e = spark.createDataFrame([(1, 5, "supports", 0.4, 0.9, "b"), (2, 5, "refutes", 0.3, 0.8, "a")], "claim_id int, signal_id int, stance string, weight double, extraction_conf double, rationale string")
    claims = spark.createDataFrame([(1, 7, "k"), (2, 7, "k"), (3, 7, None)], "claim_id int, founder_id int, dedup_key string")
    kept, folded = merge.fold_claims(claims, e)
    assert sorted(r["claim_id"] for r in kept.collect()) == [1, 3]
    assert folded.collect() == [(1, 5, "refutes", 0.4, 0.9, "a | b")]


def people(spark, *rows):
    return spark.createDataFrame([(i, n, c, k, []) for i, n, c, k in rows], "id int, display_name string, city string, company string, education array<string>")


def handles(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, kind string, value string")


def resolution(spark, mention, known, in_handles, ex_handles):
    i, e = people(spark, mention), people(spark, *known)
    h = [handles(spark, *x) if x else handles(spark, (0, "github", "nobody")).limit(0) for x in (in_handles, ex_handles)]
    return resolve.resolved(i, e, *h).first()


def test_alike_mentions_are_decided_alike(spark):
    known = people(spark, (10, "Ada Lovelace", "Zürich", None), (11, "Ada Lovelace", "Zurich", None), (12, "Ada Lovelace", "Bern", None))
    asked = people(spark, *((i, "Ada Lovelace", "zürich", None) for i in range(4)))
    none = handles(spark, (0, "github", "nobody")).limit(0)
    one_by_one = resolve.decided(asked, resolve.scored(asked, known, none, none))
    assert sorted(map(tuple, resolve.resolved(asked, known, none, none).collect())) == sorted(map(tuple, one_by_one.collect()))
    assert {r["matched_id"] for r in one_by_one.collect()} == {10}


def test_resolution_rules(spark):
    r = resolution(spark, (1, "Ada M. Lovelace", None, None), [(10, "Ada Lovelace", None, None)], [(1, "linkedin", "ada")], [(10, "linkedin", "ada")])
    assert (r["decision"], r["matched_id"], r["method"]) == ("merge", 10, "exact_key") and r["confidence"] >= 0.95
    r = resolution(spark, (1, "Ada Lovelace", "Zürich", "Engine"), [(10, "Ada Lovelace", "Zurich", "ENGINE")], [], [])
    assert (r["decision"], r["confidence"]) == ("review", 0.89)
    r = resolution(spark, (1, "Grace Hopper", None, None), [(10, "Ada Lovelace", None, None)], [(1, "github", "acme")], [(10, "github", "acme")])
    assert (r["decision"], r["method"]) == ("review", "conflict")
    r = resolution(spark, (1, "Ada Lovelace", None, None), [(10, "Ada Lovelace", None, None)], [(1, "github", "ada1")], [(10, "github", "ada2")])
    assert r["method"] == "conflict"
    r = resolution(spark, (1, "Grace Hopper", None, None), [(10, "Ada Lovelace", None, None), (11, "Alan Turing", None, None)], [(1, "github", "acme")], [(10, "github", "acme"), (11, "github", "acme")])
    assert r["decision"] == "new"  # two known people already share the handle
    assert resolution(spark, (1, "Grace Hopper", None, None), [(10, "Ada Lovelace", None, None)], [], [])["decision"] == "new"


def test_merges_follow_chains(spark):
    p = people(spark, *((i, "Ada Lovelace", None, None) for i in (1, 2, 3, 4)), (5, "Alan Turing", None, None))
    h = handles(spark, (1, "github", "a"), (2, "github", "a"), (2, "orcid", "o"), (3, "orcid", "o"), (4, "github", "x"), (5, "github", "x"))
    assert sorted(map(tuple, resolve.merges(p, h).collect())) == [(1, 1), (2, 1), (3, 1)]
    art = spark.createDataFrame([(3, "u"), (4, "u")], "id int, url string")
    # 4 shares its handle with a stranger, so nothing speaks against the artifact
    assert sorted(map(tuple, resolve.merges(p, h, art).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_groups_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id + 1 as left", "id as right")
    assert {r["canonical"] for r in graph.groups(links).collect()} == {0}


def test_deals_fold(spark):
    t, late = datetime(2026, 1, 1), datetime(2026, 2, 1)
    rows = [(2, 1, 9, "screening", t, None, None), (3, 1, 9, "decided", late, t, "ai"), (4, 1, None, "screening", t, None, "x"), (5, 1, None, "screening", t, None, "x"), (6, 2, 9, "rejected", t, t, None), (7, 2, 9, "decided", late, late, None)]
    deals = spark.createDataFrame(rows, "opportunity_id int, founder_id int, company_id int, status string, created_at timestamp, decided_at timestamp, sector string")
    got = {r["opportunity_id"]: (r["status"], r["sector"], r["n_folded"]) for r in merge.fold_deals(deals).collect()}
    assert got == {2: ("decided", "ai", 2), 4: ("screening", "x", 1), 5: ("screening", "x", 1), 6: ("rejected", None, 2)}  # of two outcomes the earlier deal's stands


def test_founder_axis_bands(spark):
    scores = spark.createDataFrame([(1, 44.5), (2, 22.1), (3, 13.5), (4, 13.5), (5, None)], "founder_id int, founder_score double")
    claims = spark.createDataFrame([(f, 0.5) for f, n in ((1, 22), (2, 8), (3, 9), (4, 5)) for _ in range(n)], "founder_id int, trust double")
    points = spark.createDataFrame([(1, 10.0, 1, 1), (1, 11.0, 2, 2), (2, 11.0, 1, 1), (2, 10.0, 2, 2), (3, 5.0, 1, 1), (3, 5.9, 2, 2)], "founder_id int, score double, created_at int, point_id int")
    got = {r["founder_id"]: (r["verdict"], r["trend"], r["gaps"]) for r in screening.founder_axis(scores, claims, points).collect()}
    assert got[1][:2] == ("bull", "improving") and got[2][:2] == ("neutral", "declining") and got[3][:2] == ("bear", "stable")
    assert got[4][0] == "neutral" and "cold start" in got[4][2] and got[5][0] == "neutral" and "no score" in got[5][2]
    df = spark.createDataFrame([(10.0, 11.0), (10.0, 11.01), (11.0, 10.0), (None, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(screening.trend(F.col("a"), F.col("b"))).collect()] == ["stable", "improving", "stable", "stable"]


def test_prose_without_ids(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(f"an approach [{u}, {u}]; then",), ("kept [2023], [Series A], [a16z], [10 cited]",)], "x string")
    assert [r[0] for r in df.select(screening.without_ids(F.col("x"))).collect()] == ["an approach; then", "kept [2023], [Series A], [a16z], [10 cited]"]


def test_thesis(spark):
    df = spark.createDataFrame([("gambling",), ("healthcare",), (None,)], "s string")
    got = [r[0] for r in df.select(screening.thesis_rejects(F.col("s"), F.array(F.lit("healthtech"), F.lit("healthcare AI")))).collect()]
    assert got == [True, False, False]


def test_places(spark):
    rows = [
        (1, "Zürich", "CH", 340_000, ["Zurich", "Turicum"]), (2, "Springfield", "US", 100, []), (3, "Springfield", "US", 90, []), (4, "Munich", "DE", 1_260_000, ["München", "Monaco"]), (5, "Roma", "LS", 14_000, []),
        (6, "Rome", "IT", 2_320_000, ["Roma"]), (7, "Lomé", "TG", 2_190_000, ["Rome"]), (8, "Singapore", "SG", 5_600_000, []), (9, "Cambridge", "GB", 130_000, []), (10, "Cambridge", "US", 118_000, []), (11, "Göttingen", "DE", 120_000, []),
        (12, "Paris", "FR", 2_100_000, []), (13, "Paris", "US", 25_000, []), (14, "Linz", "AT", 200_000, []), (15, "Linz", "XX", 160_000, []), (16, "Vienna", "AT", 1_900_000, ["Wien"]),
    ]
    gazetteer = spark.createDataFrame(rows, "geonameid int, name string, countrycode string, population bigint, alternatenames array<string>")
    countries = spark.createDataFrame([("Germany", "DE"), ("Singapore", "SG"), ("France", "FR"), ("Italy", "IT"), ("Lesotho", "LS"), ("Austria", "AT")], "name string, code string")
    asked = {
        "ZURICH": (None, "Zürich", "CH", "exact"), "Springfield": (None, None, None, None), "Munich, Bavaria, Germany": ("FR", "Munich", "DE", "exact"), "Turicum": (None, "Zürich", "CH", "alias"), "München": (None, "Munich", "DE", "alias"),
        "Roma": (None, "Rome", "IT", "inferred"), "Roma, Lesotho": (None, "Roma", "LS", "exact"), "Rome": (None, "Rome", "IT", "exact"), "Singapore": (None, "Singapore", "SG", "exact"), "Deutschland": (None, None, "DE", "country_only"),
        "Cambridge": (None, None, None, None), "Goettingen": (None, "Göttingen", "DE", "alias"), "Paris, Germany": (None, "Paris", None, "unverified"), "Linz": (None, "Linz", "AT", "prior"), "Wien": (None, "Vienna", "AT", "alias"),
        "Atlantis, France": (None, "Atlantis", "FR", "unverified"), "TUM, Germany": (None, None, "DE", "unknown"), " ": (None, None, None, "unknown"), "home / remote": (None, None, None, "unknown"),
    }
    extra = [("Cambridge", "GB", "Cambridge", "GB", "exact"), ("Cambridge", "US", "Cambridge", "US", "exact"), ("Munich", "FR", "Munich", "DE", "exact"), ("Springfield", "US", "Springfield", None, "unverified"), (None, "DE", None, None, "unknown")]
    want = {i: (raw, hint, city, code, quality) for i, (raw, (hint, city, code, quality)) in enumerate(asked.items())}
    for k in ("Springfield", "Cambridge"):
        i = list(asked).index(k)
        want[i] = (k, None, k, None, "unverified")
    want |= {100 + i: x for i, x in enumerate(extra)}
    m = spark.createDataFrame([(i, raw, hint) for i, (raw, hint, *_) in want.items()] * 2, "mention_id int, raw string, country_hint string")
    got = places.resolved(m, places.place_keys(gazetteer), countries, ["CH", "DE", "AT", "GB", "FR", "IT"]).collect()
    assert len(got) == 2 * len(want)
    # a namesake in the preferred region wins "Cambridge" without a hint
    want[list(asked).index("Cambridge")] = ("Cambridge", None, "Cambridge", "GB", "prior")
    for r in got:
        raw, _, city, code, quality = want[r["mention_id"]]
        assert (r["city"], r["country_code"], r["quality"]) == (city, code, quality), raw
    assert {r["place_key"] for r in got if r["raw"] in ("ZURICH", "Turicum")} == {"geonames:1"} and {r["place_key"] for r in got if r["raw"] == "Atlantis, France"} == {"atlantis"}
    assert places.resolved(m.limit(0), places.place_keys(gazetteer), countries, []).count() == 0


def test_a_hot_key_is_chunked_in_order(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, 'a') as k").repartition(7)
    got = sorted((r["id"], r["chunk"]) for r in views.chunked(rows, "k", ["id"], 7).collect() if r["k"] == "a")
    assert [c for _, c in got] == [i // 7 for i in range(900)]
    assert views.chunked(rows, "k", ["id"], 7).count() == 1000 and views.chunked(rows.limit(0), "k", ["id"]).count() == 0


def test_a_ledger_row_is_bounded_and_loses_nothing(spark):
    edges = spark.range(25).selectExpr("1 as founder_id", "id % 23 as signal_id")
    rows = delivery.trace_rows(edges, "step", 10).orderBy("part").collect()
    assert [len(r["evidence"]) for r in rows] == [10, 10, 3] and sum((r["evidence"] for r in rows), []) == list(range(23))


def test_keywords(spark):
    stop = ["students", "building", "tools", "at", "and", "the"]
    df = spark.createDataFrame([("c++ and C++ devs building llm.c forks",)], "x string")
    assert df.select(ingest.keywords(F.col("x"), stop, 5)).first()[0] == ["c++", "devs", "llm.c", "forks"]


def test_attribution_only_rises(spark):
    t = datetime(2026, 1, 1)
    schema = "founder_id int, signal_id int, confidence double, method string, attributed_at timestamp"
    old = spark.createDataFrame([(1, 1, 0.9, "exact_key", t), (1, 2, 0.5, "evidence", t)], schema)
    new = spark.createDataFrame([(1, 1, 0.6, "evidence", t), (1, 2, 0.8, "artifact", t)], schema)
    once = ingest.attributed(old, new)
    assert sorted(tuple(r)[:4] for r in once.collect()) == [(1, 1, 0.9, "exact_key"), (1, 2, 0.8, "artifact")]
    assert sorted(once.collect()) == sorted(ingest.attributed(once, new).collect())


def test_readers(spark, tmp_path):
    (tmp_path / "web.json").write_text('{"channel":"c","title":"","url":"https://a.test/x","content":"short","raw_content":"' + "y" * 4000 + '"}\n{"channel":"c","title":"t","url":"nonsense","content":"z"}\n')
    rows = readers.reader("unheard-of")(spark, str(tmp_path / "web.json")).collect()
    assert [(r["title"], len(r["content"])) for r in rows] == [("https://a.test/x", 3500)]
    (tmp_path / "feed.xml").write_text("<feed><entry><id> http://arxiv.org/abs/1 </id><title>A\n  title</title><summary>s  s</summary><published>2026</published><author><name>Ada L</name></author><author><name>Alan T</name></author></entry></feed>")
    row = readers.reader("arxiv")(spark, str(tmp_path / "feed.xml")).first()
    assert row["title"] == "A title" and row["content"].startswith("authors: Ada L, Alan T")
    df = spark.createDataFrame([("see &lt;a href=&quot;https:&#x2F;&#x2F;widgets.example&quot; rel=&quot;x&quot;&gt;widgets&lt;/a&gt; &amp; more",)], "x string")
    assert df.select(readers.plain_text(F.col("x"))).first()[0] == "see https://widgets.example & more"
    decks = spark.createDataFrame([("d", "Acme", 1, "hi"), ("d", "Acme", 2, " "), ("e", "Void", 1, None)], "deck_id string, company string, page int, text string")
    assert sorted(r["external_id"] for r in readers.deck_pages(decks).collect()) == ["d#1", "d#2"]


def test_stream_appends_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1", 1), ("s", "2", 2), ("s", "1", 3)], "source string, external_id string, n int")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the second delivery is a replay
        rows.coalesce(1).write.mode("append").parquet(src)
        query = stream.run_once(spark.readStream.schema(rows.schema).parquet(src), stream.append_new(out, ["source", "external_id"], ["n"], ingest.upsert_new), str(tmp_path / "cp"))
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("s", "1", 1), ("s", "2", 2)]


def test_jobs_do_not_depend_on_partitioning(spark):
    e = evidence(spark, *((i % 7, i % 5, "supports" if i % 3 else "refutes", (i % 10) / 10, f"s{i % 4}") for i in range(200)))
    a, b = (sorted(C.trust(x).collect()) for x in (e.repartition(1), e.repartition(13)))
    assert a == b
