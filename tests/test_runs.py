"""Ledgers, gates, pages and figures on small rows."""

import os

import pytest
from pyspark.sql import functions as F

from scoutlake.operators import ledger, market, ranks, repairs


def test_counts_are_taken_while_writing(spark, tmp_path):
    items = spark.createDataFrame([("sizing",), ("sizing",), ("kpi",), (None,)], "extractor string")
    rows = {"queries": items.limit(0), "hits": spark.range(5), "items": items}
    row = ledger.run(spark, "market", rows, ledger.market_counts(), str(tmp_path)).first()
    assert row["source"] == "market" and row["started_at"] <= row["finished_at"]
    assert row["counts"] == {"queries_run": 0, "hits": 5, "sizing_figures": 2, "competitors": 0, "comparables": 0, "kpi_benchmarks": 1}
    assert spark.read.parquet(f"{tmp_path}/items").count() == 4
    claims = spark.createDataFrame([(1, "cold", 3, 0), (2, "warm", 1, 2)], "founder_id long, mode string, minted long, attached long")
    row = ledger.run(spark, "claims", {"runs": claims}, ledger.claims_counts(), f"{tmp_path}/claims").first()
    assert row["counts"] == {"founders_processed": 2, "cold_founders": 1, "new_signals": 4, "evidence_attached": 2}


IDENTITY = "identity_id long, founder_id long, kind string, value string"


def test_a_clean_snapshot_passes_the_gate(spark, tmp_path):
    rows = [(1, 1, "github", "ada"), (2, 1, "github", "https://github.com/Bob"), (3, 2, "github", "Ada"), (3, 2, "github", None), (4, 2, "orcid", "0000-0002-1825-0097"), (5, 3, "github", "https://github.com/orgs/a")]
    counts = repairs.repaired_identities(spark.createDataFrame(rows, IDENTITY), f"{tmp_path}/a")
    assert {k: v for k, v in counts.items() if v} == {"github_kept": 1, "github_rewritten": 2, "github_cleared": 1, "orcid_kept": 1}
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/a").select("identity_id", "founder_id", "kind", "value").collect())
    assert got == [(1, 1, "github", "ada"), (2, 1, "github", "bob"), (3, 2, "github", "ada"), (4, 2, "orcid", "0000-0002-1825-0097")]
    assert not any(repairs.repaired_identities(spark.createDataFrame([], IDENTITY), f"{tmp_path}/b").values())


@pytest.mark.parametrize("rows", [[(1, 1, "github", "ada"), (2, 1, "github", "https://github.com/Ada")], [(1, 1, "orcid", "0000-0002-1825-0097"), (2, 2, "orcid", "https://orcid.org/0000-0002-1825-0097")]])
def test_a_violating_snapshot_is_refused(spark, tmp_path, rows):
    with pytest.raises(Exception, match="identity rows"):
        repairs.repaired_identities(spark.createDataFrame(rows, IDENTITY), f"{tmp_path}/t")
    assert not os.path.exists(f"{tmp_path}/t/_SUCCESS") and not [f for f in (os.listdir(f"{tmp_path}/t") if os.path.isdir(f"{tmp_path}/t") else []) if f.endswith(".parquet")]


def test_figures_of_any_shape(spark):
    given = ['{"metric": "TAM", "value": 12, "unit": "bn", "confidence": "0.7", "note": {"a": [1]}}', '{"value": {"low": 1}}', "[1]", "7", "nonsense", "", None, '{"metric": null}', "{}"]
    claims = spark.createDataFrame([(n, 1, "market", a, 0.5, "unverified") for n, a in enumerate(given)], "claim_id long, opportunity_id long, category string, attributes string, trust double, status string")
    urls = spark.createDataFrame([], "claim_id long, url string")
    got = {r["claim_id"]: (r["metric"], r["value"], r["unit"], r["confidence"], r["more"]) for r in market.figures_of_any_shape(claims, urls).collect()}
    assert got[0] == ("TAM", "12", "bn", 0.7, {"note": '{"a":[1]}'})
    assert got[1][0] is None and got[1][4] == {}
    assert got[7][:4] == (None, None, None, None) and set(got) == set(range(9))
    assert all(got[n] == (None,) * 5 for n in (2, 3, 4, 5, 6))


def test_no_rows_make_no_pages(spark, tmp_path):
    ranks.write_pages(spark.range(3).filter("id < 0"), ["id"], f"{tmp_path}/p")
    index = spark.read.schema("id long, position long, page long, page_block long").parquet(f"{tmp_path}/p")
    assert ranks.read_page(index, 0).count() == 0 == ranks.read_page(index, 5).count()
    ranks.write_pages(spark.range(3), [F.desc("id")], f"{tmp_path}/q", size=2)
    assert [r["id"] for r in ranks.read_page(spark.read.parquet(f"{tmp_path}/q"), 9, block=1000).collect()] == [0]
