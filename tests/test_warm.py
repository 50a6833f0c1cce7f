"""Claims that grow batch by batch: minted, joined, tried again."""

import datetime as dt

from pyspark.sql import functions as F

from scoutlake.operators import warm

SIGNAL = "founder_id long, signal_id long, source string, ingested_at timestamp, occurred_at timestamp, weight double"


def signal(founder, n, weight=0.5):
    return (founder, n, "web", dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), None, weight)


def extract(fresh):
    k = F.col("signal_id")
    return fresh.select(
        "founder_id", k.alias("claim_no"), F.when(k == 7, " ").otherwise("said").alias("statement"), F.when(k == 8, "gossip").otherwise("research").alias("category"), F.lit(0.5).alias("impact"),
        F.when(k % 2 == 0, "even").alias("dedup_key"), F.array("pos").alias("supporting"), F.lit(None).cast("array<int>").alias("refuting"),
    )


def decide(extracted, existing):
    """Signal 11 refutes claim 1; 13 names a claim of another founder."""
    rows = extracted.filter("claim_no in (11, 13)")
    return rows.select("founder_id", "claim_no", F.lit("match").alias("action"), F.when(F.col("claim_no") == 11, 1).otherwise(20).cast("long").alias("existing_claim_id"), F.lit("refutes").alias("stance"))


def test_batches_mint_join_and_refute(spark, tmp_path):
    folder, as_of = str(tmp_path / "warm"), F.lit("2024-06-01").cast("timestamp")
    batches = [
        [signal(1, 1), signal(1, 2), signal(1, 2), signal(1, 4), signal(2, 20), (None, 30, "web", None, None, 0.5)],
        [signal(1, 2), signal(1, 4), signal(1, 6), signal(1, 7), signal(1, 8)],  # two repeats, one that joins, two that say nothing
        [],
        [signal(1, 11, 0.9), signal(1, 13), signal(2, 19)],  # 19 came too late for founder 2
    ]
    for k, rows in enumerate(batches):
        for _ in range(2 if k in (1, 3) else 1):  # tried again
            warm.apply_batch(folder, k, spark.createDataFrame(rows, SIGNAL), extract, as_of, decide, buckets=2)
    got = {r["claim_id"]: (r["founder_id"], r["batch"], r["dedup_key"], r["corroboration_n"], r["refutation_n"], r["status"]) for r in warm.claims(spark, folder).collect()}
    assert got == {
        1: (1, 0, None, 1, 1, "contradicted"),  # joined by a decision, against it
        2: (1, 0, "even", 2, 0, "verified"),  # 6 joins by the key: 1 - 0.5 * 0.5
        4: (1, 0, None, 1, 0, "unverified"),  # the key was taken within its batch
        13: (1, 3, None, 1, 0, "unverified"),  # the named claim is another founder's
        20: (2, 0, "even", 1, 0, "unverified"),
    }
    runs = sorted((r["batch"], r["founder_id"], r["mode"], r["n_signals"], r["minted"], r["attached"]) for r in warm.runs(spark, folder).collect())
    assert runs == [(0, 1, "cold", 3, 3, 0), (0, 2, "cold", 1, 1, 0), (1, 1, "warm", 3, 0, 1), (3, 1, "warm", 2, 1, 1)]
