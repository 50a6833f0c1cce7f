"""The pipeline's stages on odd tables."""

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The quick brown fox jumps over the lazy dog, and then it rests by the river for a while. "


def tables(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("component_id", F.lit(7)).withColumn("length", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows():
    good = [(i, f"{GOOD * (1 + i % 3)}number {i} of them all. " + " ".join(f"w{i}x{k}" for k in range(30)), "en", None if i % 5 == 0 else "s", None) for i in range(40)]
    bad = [(100 + i, "$$$ !!! ### " * (5 + i), None, "s", 3) for i in range(40)]
    odd = [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (None, GOOD * 2, "en", "s", 1), (None, None, None, None, None), (3, good[3][1], "en", "s", None), (202, good[7][1], "en", "s", None), (203, GOOD * 4000, "en", "s", 1)]
    return good, bad, odd


def test_stages_on_odd_rows(spark, tmp_path):
    good, bad, odd = rows()
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 1), (5, None, None), (9999, 0, 1)]
    sf = tables(spark, tmp_path, good + bad + odd, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = pipeline.quality_filter(spark, docs, sf)
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == pipeline.COLUMNS and set(range(40)) <= kept and not kept & set(range(100, 140))
    second = pipeline.toxicity_filter(spark, first, sf)
    assert second.columns == pipeline.COLUMNS and second.count() == first.count()  # no toxic label is left
    third = pipeline.simhash_dedup(spark, docs, sf)
    ids = [r["doc_id"] for r in third.collect()]
    assert third.columns == pipeline.COLUMNS and ids.count(3) == 1 and 202 not in ids and 7 in ids and 200 in ids and 201 not in ids and ids.count(None) == 2
    last = pipeline.pack(spark, docs, sf).collect()
    assert sum(r["doc_id"] == 203 for r in last) > 5 and sum(r["doc_id"] is None for r in last) == 2 and sum(r["doc_id"] == 3 for r in last) == 2
    assert [r["length"] for r in last if r["doc_id"] in (200, 201)] == [1, 1]
    out = pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} >= set(range(40)) - {3} and not {r["doc_id"] for r in out} & {202, *range(100, 140)}


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert pipeline.run(spark, sf).count() == 0
    docs = spark.createDataFrame(rows()[0], DOCS)
    assert pipeline.quality_filter(spark, docs, sf).count() == len(rows()[0])  # without labels, by the prior of a half
    assert pipeline.toxicity_filter(spark, docs, sf).count() == len(rows()[0])
