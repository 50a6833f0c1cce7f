"""Steps of the batch state: what a batch changes comes from one aggregate, and large steps are no checkpoints of rows."""

import os

from pyspark.sql import functions as F

from scoutlake.operators import incremental as I

EDGE = "founder_id long, claim_id long, signal_id long, stance string, weight double, source string"


def checkpoints(spark):
    from scoutlake.operators.graph import shared_folder

    path = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(path) if n.startswith("rdd-")}


def test_changed_edges_are_new_grown_or_turned(spark):
    old = [(1, 1, 1, "supports", 0.5, "b"), (1, 1, 1, "supports", 0.6, "b"), (1, 1, 2, "supports", 0.5, "b"), (1, 1, 3, "refutes", 0.5, None), (1, 1, 4, "supports", 0.5, "b"), (1, 1, 9, "supports", 0.1, "b")]
    new = [(1, 1, 1, "supports", 0.6, "b"), (1, 1, 1, "supports", 0.2, "c"), (1, 1, 2, "refutes", 0.1, "c"), (1, 1, 3, "supports", 0.9, None), (1, 1, 4, "supports", 0.1, "a"), (1, 1, 5, "supports", None, None), (1, 1, 5, "refutes", 0.3, "z")]
    got = I.changed_edges(spark.createDataFrame(old, EDGE), spark.createDataFrame(new, EDGE))
    assert sorted(tuple(r)[2:] for r in got.collect()) == [
        (2, "refutes", 0.5, "b", "supports", 0.5), (3, "refutes", 0.9, None, "refutes", 0.5), (4, "supports", 0.5, "a", "supports", 0.5), (5, "refutes", 0.3, "z", None, None),
    ]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("hashpartitioning") == 1


def test_a_batch_of_evidence_leaves_no_checkpoints_of_rows(spark, tmp_path):
    claims = spark.createDataFrame([(1, 1, "media", 0.5, None)], "claim_id long, founder_id long, category string, impact double, occurred_at timestamp")
    raw = spark.createDataFrame([(1, 7, "supports", 0.5, 1.0, 1.0, "s")], "claim_id long, signal_id long, stance string, reliability double, confidence double, relevance double, source string")
    before = checkpoints(spark)
    I.apply_batch(str(tmp_path), 0, raw, claims, F.lit("2026-01-01").cast("timestamp"), buckets=2)
    assert checkpoints(spark) == before
    assert I.claim_trusts(spark, str(tmp_path)).first()["support"] == 0.5


def test_claims_are_routed_and_minted_without_joining_them_to_themselves(spark):
    from scoutlake.operators import claims as C
    from scoutlake.operators import warm
    from scoutlake.operators.graph import nothing

    fresh = spark.createDataFrame([(1, n, n, 0.5, None) for n in range(4)], "founder_id long, pos int, signal_id long, weight double, occurred_at timestamp")
    extracted = fresh.select(
        "founder_id", F.col("signal_id").alias("claim_no"), F.lit("said").alias("statement"), F.lit("media").alias("category"), F.lit(0.5).alias("impact"), F.when(F.col("pos") < 2, "k").alias("dedup_key"),
        F.when(F.col("pos") != 3, F.array("pos")).alias("supporting"), F.when(F.col("pos") >= 1, F.array(F.col("pos") - 1)).alias("refuting"),
    )
    existing = spark.createDataFrame([(1, 90, "media", "k")], "founder_id long, claim_id long, category string, dedup_key string")
    none = nothing(spark, "founder_id long, claim_no long, action string, existing_claim_id long, stance string")
    plan = C.routed(extracted, existing, none)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1  # by key; nobody decides
    before = checkpoints(spark)
    made, edges, went = warm.grown(extracted, fresh, existing, none)
    assert [(r["claim_id"], r["n_evidence"]) for r in C.mint(extracted.filter("claim_no = 2"), fresh, existing)[0].withColumnRenamed("claim_no", "claim_id").collect()] == [(2, 2)]
    assert [r["claim_id"] for r in made.collect()] == [2]  # 3 is only cited against
    assert sorted((r["claim_id"], r["signal_id"], r["stance"]) for r in edges.collect()) == [(2, 1, "refutes"), (2, 2, "supports"), (90, 0, "supports"), (90, 1, "supports")]
    assert sorted((r["claim_no"], r["action"]) for r in went.collect()) == [(0, "attach"), (1, "attach"), (2, "mint"), (3, "mint")]
    assert checkpoints(spark) == before


def test_few_rows_are_dealt_to_few_ranges(spark):
    from scoutlake.operators.ranks import ranked

    before = checkpoints(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = ranked(spark.range(100).selectExpr("id % 3 as k", "id"), ["k"], ["id"])
        assert all(r["position"] == r["id"] // 3 + 1 for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    from scoutlake.operators.graph import shared_folder

    path = shared_folder(spark).removeprefix("file:")
    assert all(len([n for n in os.listdir(f"{path}/{d}") if n.startswith("part-")]) < 64 for d in checkpoints(spark) - before)
