"""Run ledgers: a row for each run, its counts taken while its results are written."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a run writes: rows, the path they go to, and the counts to take from them.
Output = tuple[DataFrame, str, dict[str, Column]]


def written(output: Output) -> dict[str, int]:
    """Write an output; its counts come from the same pass. Rows that the optimiser knows to be none count as zeros."""
    rows, path, counts = output
    seen = Observation()
    rows.observe(seen, *(c.alias(name) for name, c in counts.items())).write.parquet(path)
    got = seen.get
    return {name: int(got.get(name) or 0) for name in counts}


def recorded(spark: SparkSession, source: str, outputs: list[Output]) -> DataFrame:
    """Write a run's outputs and return its ledger row: (source, started_at, finished_at, counts as a map). An output that
    fails ends the run without a row; what the ones before it wrote stays."""
    started = dt.datetime.now(dt.UTC)
    counts: dict[str, int] = {}
    for output in outputs:
        counts |= written(output)
    return spark.createDataFrame([(source, started, dt.datetime.now(dt.UTC), counts)], "source string, started_at timestamp, finished_at timestamp, counts map<string, long>")


def discovery_counts() -> dict[str, dict[str, Column]]:
    """The counts of a discovery run by what they are taken from: queries, hits, candidates, founders (with status), signals."""
    n = F.count(F.lit(1))
    return {"queries": {"queries_run": n}, "hits": {"raw_hits": n}, "candidates": {"candidates_extracted": n}, "founders": {"new_founders": n, "needs_review": F.count_if(F.col("status") == "needs_review")}, "signals": {"new_signals": n}}


def market_counts() -> dict[str, dict[str, Column]]:
    """The counts of a market run: queries, hits, and extracted items (with extractor), all four kinds in one pass."""
    n = F.count(F.lit(1))
    of = {"sizing_figures": "sizing", "competitors": "competition", "comparables": "comparables", "kpi_benchmarks": "kpi"}
    return {"queries": {"queries_run": n}, "hits": {"hits": n}, "items": {name: F.count_if(F.col("extractor") == e) for name, e in of.items()}}


def claims_counts() -> dict[str, dict[str, Column]]:
    """The counts of a claims run from its row for each founder (`warm.runs`)."""
    return {"runs": {"founders_processed": F.count(F.lit(1)), "cold_founders": F.count_if(F.col("mode") == "cold"), "new_signals": F.sum("minted"), "evidence_attached": F.sum("attached")}}


def run(spark: SparkSession, source: str, rows: dict[str, DataFrame], counts: dict[str, dict[str, Column]], folder: str) -> DataFrame:
    """Record a run whose results `rows` are named as in `counts`; each goes to a folder of its name."""
    return recorded(spark, source, [(rows[name], f"{folder}/{name}", c) for name, c in counts.items()])
