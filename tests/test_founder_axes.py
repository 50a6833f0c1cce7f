"""Founder axes put in place of older ones."""

from pyspark.sql import functions as F

from scoutlake.operators import screening


def test_axes_and_evidence_of_deals(spark):
    deals = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "opportunity_id long, founder_id long")
    row = "opportunity_id long, axis string, score double, verdict string, trend string, confidence double, gaps string"
    existing = spark.createDataFrame([(1, "founder", 1.0, "bear", "declining", 0.1, ""), (1, "idea", 2.0, "bull", "stable", 0.2, ""), (9, "founder", 3.0, "bull", "stable", 0.3, "")], row)
    scores = spark.createDataFrame([(10, 55.0), (12, 1.0)], "founder_id long, founder_score double")
    claims = spark.createDataFrame([(10, 100, 0.5), (10, 101, None), (12, 102, 0.9)], "founder_id long, claim_id long, trust double")
    points = spark.createDataFrame([(10, 40.0, 1, 1), (10, 55.0, 2, 2)], "founder_id long, score double, created_at long, point_id long").withColumn("created_at", F.timestamp_seconds("created_at"))
    cites = spark.createDataFrame([(100, 1, "supports"), (100, 2, "supports"), (100, 3, "refutes"), (101, 4, "supports")], "claim_id long, signal_id long, stance string")
    signals = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None)], "signal_id long, url string")
    rows, evidence = screening.upserted_founder_axes(deals, existing, scores, claims, points, cites, signals)
    got = {(r["opportunity_id"], r["axis"]): (r["score"], r["verdict"], r["trend"]) for r in rows.collect()}
    assert got == {(1, "founder"): (55.0, "bull", "improving"), (2, "founder"): (55.0, "bull", "improving"), (3, "founder"): (None, "neutral", "stable"), (1, "idea"): (2.0, "bull", "stable"), (9, "founder"): (3.0, "bull", "stable")}
    assert sorted(map(tuple, evidence.collect())) == [(1, 100, 0.5, "u"), (1, 101, None, None), (2, 100, 0.5, "u"), (2, 101, None, None)]
