"""Queries read and hash whole inputs: rows and texts that a cut would lose."""

import hashlib
import os
import re

import pytest
from conftest import DATA

import __spark_entry__ as entry
from scoutlake.operators import ingest, views
from scoutlake.sources import readers

SF = f"{DATA}/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_profiles_late_in_a_text(spark, tmp_path):
    rows = [(1, "word " * 2000 + "https://github.com/Ada and https://github.com/Other"), (2, "short"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["founder_id"], r["kind"]): r["value"] for r in entry.queries()["profiles_in_pages"](spark, str(tmp_path)).collect()}
    assert (got[1, "github"], got[2, "github"], got[3, "github"]) == ("ada", "dev2", "dev3")
    assert (got[1, "twitter"], got[1, "linkedin"]) == ("tw1", "in-1") and len(got) == 9


def test_pages_that_differ_late_have_different_hashes(spark, tmp_path):
    head = "<html><title>T</title>" + "<li>menu</li>" * 200
    pages = [(1, "https://e.test/1", head + "one"), (2, "https://e.test/2", head + "two"), (3, "https://e.test/3", head + " \n ONE".strip()), (4, "https://e.test/4", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["content_hash"] for r in entry.queries()["page_signal_keys"](spark, str(tmp_path)).collect()}
    assert got[1] != got[2] and got[1] == got[3] and got[4] is None
    assert {r["page_id"]: len(r["excerpt"] or "") for r in readers.landed(spark, str(tmp_path)).collect()} == {1: 1500, 2: 1500, 3: 1500, 4: 0}


@here
def test_page_hashes_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["content_hash"] for r in ingest.signal_keys(readers.landed(spark, SF)).collect()}
    for p in pages:
        title = re.search("(?s)<title>(.*?)</title>", p["html"])
        words = re.sub(r"\s+", " ", f"{title[1] if title else ''} {p['html']}".lower()).strip()
        assert got[p["page_id"]] == hashlib.sha256(words.encode()).hexdigest()


def test_founders_with_many_children_lose_none(spark):
    founders = spark.createDataFrame([(1, "a"), (2, "b")], "founder_id long, display_name string")
    signals = spark.range(170).selectExpr("1L as founder_id", "id as signal_id", "timestamp_seconds(id div 2) as ingested_at", "'web' as source")
    claims = spark.range(120).selectExpr("1L as founder_id", "id as claim_id", "if(id % 3 = 0, null, (id % 7) / 10) as trust", "'x' as status")
    got = {r["founder_id"]: r for r in views.founder_detail(founders, signals, claims).collect()}
    assert (got[1]["n_signals"], got[1]["latest_signal"], got[1]["n_claims"], got[1]["best_claim"], got[1]["best_trust"]) == (170, 168, 120, 13, 0.6)
    assert (got[2]["n_signals"], got[2]["latest_signal"], got[2]["n_claims"]) == (0, None, 0)
    s, c = views.founder_children(founders, signals, claims)
    assert [r["signal_id"] for r in s.collect()] == sorted(range(170), key=lambda i: (-(i // 2), i))
    assert [r["claim_id"] for r in c.collect()] == sorted(range(120), key=lambda i: (i % 3 == 0, -(i % 7) if i % 3 else 0, i))
