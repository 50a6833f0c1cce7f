"""Texts in bounded pieces, edges of merged signals, attributes and lists: small cases by hand."""

from pyspark.sql import functions as F

from scoutlake.operators import claims as C
from scoutlake.operators import ingest as I
from scoutlake.operators import intake as N
from scoutlake.operators import screening as S
from scoutlake.operators import views as V


def test_claims_of_a_hot_founder_come_in_texts_of_bounded_size(spark):
    ids = spark.range(3000)
    rows = ids.select(F.col("id").alias("claim_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("founder_id"), F.lit("media").alias("category"), F.lit(0.5).alias("trust"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("statement"))
    out = S.claim_chunks(rows, "founder_id", "Founder", 10).collect()
    hot = sorted((r for r in out if r.founder_id == 7), key=lambda r: r.chunk)
    assert [r.chunk for r in hot] == list(range(100)) and {r.n_claims for r in hot} == {10}
    lines = [line for r in hot for line in r.block.split("\n")[1:]]
    assert lines == [f"[{i}] (media, trust=0.5) s{i}" for i in range(0, 3000, 3)]
    assert S.claim_chunks(rows.limit(0), "founder_id", "Founder").count() == 0


def test_pages_in_texts(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (1, 4, None), (1, 5, "a"), (2, 1, None)], "deck_id int, page int, text string")
    out = {(r.deck_id, r.chunk): (r.block, r.n_pages) for r in N.page_chunks(pages, 2).collect()}
    assert out == {(1, 0): ("[deck p.1]\na\n\n[deck p.2]\nb", 2), (1, 1): ("[deck p.5]\na", 1)}


def test_merged_edges_stay_whole(spark):
    signals = spark.createDataFrame([(1, "web", "u", 5), (2, "web", "u", 3), (3, "web", "u", 9), (4, "hn", "u", 1), (5, "web", "v", 1)], "signal_id long, source string, canonical_url string, ingested_at long")
    edges = spark.createDataFrame([(10, 1, 0.9, "refutes"), (10, 3, 1.0, "supports"), (11, 2, 0.1, "supports"), (11, 3, 0.8, "refutes"), (12, 5, 0.3, None), (12, 4, None, "supports"), (13, 99, 0.5, "supports")], "claim_id long, signal_id long, weight double, stance string")
    survivors, mapping, moved = I.merged_urls(signals, (edges, "claim_id"))
    assert {(r.signal_id, r.n) for r in survivors.collect()} == {(2, 3), (4, 1), (5, 1)}
    assert mapping.filter("signal_id = 3").first().survivor == 2
    # 10: neither edge is the survivor's, the earlier signal's counts; 11: the survivor's own stays, however weak
    assert {tuple(r) for r in moved.collect()} == {(10, 2, 0.9, "refutes"), (11, 2, 0.1, "supports"), (12, 5, 0.3, None), (12, 4, None, "supports")}


def test_rekeyed_external_ids_follow_the_url(spark):
    rows = spark.createDataFrame([("a", "a"), ("x", "b"), (None, None)], "external_id string, canonical_url string")
    assert {tuple(r) for r in I.rekeyed(rows, F.concat(F.lit("new-"), "canonical_url")).collect()} == {("new-a", "new-a"), ("x", "new-b"), (None, None)}


def test_attributes_and_lists(spark):
    claims = spark.createDataFrame([(1, {"impact": "high", "k": "v"}, 0.5), (2, None, None)], "claim_id int, attributes map<string,string>, impact double")
    cited = spark.createDataFrame([(1, "2001-02-03 04:05:06"), (1, "2000-01-01 00:00:00"), (1, None)], "claim_id int, at string").select("claim_id", F.col("at").cast("timestamp").alias("occurred_at"))
    got = {r.claim_id: r.attributes for r in C.with_attributes(claims, cited).collect()}
    assert got == {1: {"k": "v", "impact": "0.5", "occurred_at": "2001-02-03T04:05:06"}, 2: {"impact": None, "occurred_at": None}}
    lists = spark.createDataFrame([(None, None, None), ([1], ["a"], "x")], "a array<int>, b array<string>, c string")
    assert [tuple(r) for r in V.without_null_lists(lists).collect()] == [([], [], None), ([1], ["a"], "x")]
    assert {tuple(r) for r in V.facets(lists, "c").collect()} == {("x", 1)}


def test_several_facets_at_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("b", 1)], "status string, city int")
    got = {tuple(r) for r in V.facet_counts(rows, "status", "city").collect()}
    assert got == {("status", "a", 2), ("status", "b", 1), ("city", "1", 2), ("city", "2", 1)}
