"""Claims of founders built as signals arrive: cold for a founder without claims, warm for others, batch by batch.

Logs of claims and cursors, partitioned by batch and by a bucket of founders, and the state of `incremental` hold what is
known. A batch takes the signals after each founder's cursor, has claims extracted from them, joins an extracted claim to
the claim it repeats or mints it, brings trust and scores up to date for what it touched, and moves the cursors. It reads
the buckets of its own founders and the batches before it only, and overwrites its own partitions, so a batch that is tried
again adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import claims as C
from . import incremental as I
from .graph import nothing, stored
from .ranks import ranked

_CLAIM = "founder_id long, claim_id long, category string, statement string, impact double, dedup_key string, occurred_at timestamp, batch long, bucket int"
_CURSOR = "founder_id long, last_claimed_at timestamp, batch long, bucket int"
_RUN = "founder_id long, mode string, n_signals long, minted long, attached long, batch long, bucket int"
_EVER = 1 << 62


def fresh_signals(signals: DataFrame, cursors: DataFrame) -> DataFrame:
    """The signals after their founder's cursor, or all of one without a cursor, numbered from 0 within the founder by
    ingestion time. Repeats of a signal within the batch count once; signals without founder or time are left out."""
    once = signals.filter("founder_id is not null and ingested_at is not null").dropDuplicates(["founder_id", "signal_id"])
    at = cursors.groupBy("founder_id").agg(F.max("last_claimed_at").alias("_cursor"))
    new = once.join(at, "founder_id", "left").filter(F.col("_cursor").isNull() | (F.col("ingested_at") > F.col("_cursor"))).drop("_cursor")
    return ranked(new, ["founder_id"], ["ingested_at", "signal_id"], "pos").withColumn("pos", (F.col("pos") - 1).cast("int"))


def grown(extracted: DataFrame, fresh: DataFrame, existing: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New claims, all new edges (founder_id, claim_id, signal_id, stance, weight), and how each extracted claim went
    (founder_id, claim_no, action).

    An extracted claim whose key a claim of the founder has, or that a decision (founder_id, claim_no, action,
    existing_claim_id, stance) joins to a claim of its category, adds its supporting signals to that claim, for it or, if the
    decision says so, against it. Others are minted; `claim_no` is then the claim's id and has to be unique. Claims of one
    batch are held against those of earlier batches only."""
    routed = stored(C.routed(C.valid(extracted), existing, decisions))
    stance = decisions.groupBy("founder_id", "claim_no").agg(F.min("stance").alias("_said"))
    old = routed.filter("action = 'attach'").join(stance, ["founder_id", "claim_no"], "left")
    against = F.when(F.col("by_key").isNull() & (F.col("_said") == "refutes"), "refutes").otherwise("supports")
    cites = old.select("founder_id", "claim_no", "claim_id", against.alias("stance"), F.explode("supporting").alias("pos"))
    added = cites.join(fresh.select("founder_id", "pos", "signal_id", "weight"), ["founder_id", "pos"]).select("founder_id", "claim_id", "signal_id", "stance", "weight")
    taken = existing.filter("dedup_key is not null").select("founder_id", "dedup_key")
    claims, edges = C.mint(routed.filter("action = 'mint'").select(*extracted.columns), fresh.select("founder_id", "pos", "signal_id", "weight", "occurred_at"), taken)
    made = claims.select("founder_id", F.col("claim_no").alias("claim_id"), "category", "statement", "impact", "dedup_key", "occurred_at")
    return made, edges.withColumnRenamed("claim_no", "claim_id").select(*added.columns).unionByName(added), routed.select("founder_id", "claim_no", "action")


def apply_batch(folder: str, batch: int, signals: DataFrame, extract: Callable[[DataFrame], DataFrame], as_of: Column, decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = I.BUCKETS) -> None:
    """One batch of signals (founder_id, signal_id, ingested_at, occurred_at, weight, and what `extract` reads).

    `extract` turns fresh signals, numbered by `pos`, into extracted claims (as `claims.mint` has them); `decide` says which
    of them repeat an existing claim (none, if not given). Both stand for tables that a language model filled."""
    spark = signals.sparkSession
    bucket = F.pmod(F.xxhash64("founder_id"), F.lit(buckets)).cast("int").alias("bucket")
    touched = [r[0] for r in signals.filter("founder_id is not null").select(bucket).distinct().collect()]  # at most `buckets` numbers
    log = lambda name, schema: I._log(spark, f"{folder}/{name}", schema, batch, touched)
    fresh = stored(fresh_signals(signals, log("cursors", _CURSOR)))
    people = fresh.select("founder_id").distinct()
    existing = log("claims", _CLAIM).drop("batch", "bucket")
    # read by six steps; where there is none yet, the plans of these lose the joins with it
    existing = existing.limit(0) if existing.isEmpty() else stored(existing.join(people, "founder_id", "left_semi"))
    extracted = stored(extract(fresh))
    none = nothing(spark, "founder_id long, claim_no long, action string, existing_claim_id long, stance string")
    made, edges, routed = grown(extracted, fresh, existing, none if decide is None else decide(extracted, existing))
    made = I._appended(made.select("*", bucket), f"{folder}/claims", batch).drop("bucket")
    raw = edges.join(fresh.select("founder_id", "signal_id", "source"), ["founder_id", "signal_id"]).select("claim_id", "signal_id", "stance", F.col("weight").alias("reliability"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("relevance"), "source")
    I.apply_batch(f"{folder}/state", batch, raw, existing.unionByName(made), as_of, buckets)
    went = routed.groupBy("founder_id").agg(F.count_if(F.col("action") == "mint").alias("minted"), F.count_if(F.col("action") == "attach").alias("attached"))
    mode = existing.select("founder_id").distinct().withColumn("mode", F.lit("warm"))
    runs = fresh.groupBy("founder_id").agg(F.count("*").alias("n_signals"), F.max("ingested_at").alias("last_claimed_at")).join(mode, "founder_id", "left").join(went, "founder_id", "left")
    runs = stored(runs.select("founder_id", F.coalesce("mode", F.lit("cold")).alias("mode"), "n_signals", F.coalesce("minted", F.lit(0)).alias("minted"), F.coalesce("attached", F.lit(0)).alias("attached"), "last_claimed_at"))
    I._append(runs.drop("last_claimed_at").select("*", bucket), f"{folder}/runs", batch)
    I._append(runs.select("founder_id", "last_claimed_at", bucket), f"{folder}/cursors", batch)


def writer(folder: str, extract: Callable[[DataFrame], DataFrame], as_of: Column, decide: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = I.BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of a stream of signals."""
    return lambda rows, batch: apply_batch(folder, batch, rows, extract, as_of, decide, buckets)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """All claims so far with their trust."""
    trust = I.claim_trusts(spark, f"{folder}/state").drop("founder_id")
    return I._log(spark, f"{folder}/claims", _CLAIM, _EVER, None).drop("bucket").join(trust, "claim_id", "left")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch did for each founder that it touched: (founder_id, mode, n_signals, minted, attached, batch)."""
    return I._log(spark, f"{folder}/runs", _RUN, _EVER, None).drop("bucket")
