"""Positions within hot keys, and pages, against plain sorting."""

import random
from itertools import groupby

from pyspark.sql import functions as F

from scoutlake.operators import ranks

ROWS = "k string, t timestamp, v double, id long"


def sample(spark, n=3000):
    draw = random.Random(4)
    rows = [(draw.choice(["hot", None, "c", f"k{i % 50}"]), None, draw.choice([None, 1.0, 2.5, float(i % 7)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, ROWS).repartition(7)


def expected(rows, key, order):
    out = {}
    for _, group in groupby(sorted(rows, key=key), key):
        out |= {r[3]: n for n, r in enumerate(sorted(group, key=order), 1)}
    return out


def test_ranks_in_hot_and_null_keys(spark):
    rows, df = sample(spark)
    got = ranks.ranked(df, ["k"], [F.desc_nulls_last("v"), "id"])
    assert got.columns == [*df.columns, "position"]
    want = expected(rows, lambda r: (r[0] is not None, r[0] or ""), lambda r: (r[2] is None, -(r[2] or 0.0), r[3]))
    assert {r["id"]: r["position"] for r in got.collect()} == want
    per_task = got.filter("k = 'hot'").select(F.floor((F.col("position") - 1) / 100).alias("c")).distinct().count()
    assert per_task >= 7


def test_a_hot_key_lies_in_many_ranges(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    dealt = df.repartitionByRange(4, "k", "id").filter("k = 'hot'").select(F.spark_partition_id().alias("p"))
    assert dealt.distinct().count() >= 2
    got = ranks.ranked(df, ["k"], ["id"]).filter("k = 'hot'")
    assert got.filter("position <> id div 3 + 1").count() == 0 and got.count() == 3000


def test_two_keys_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 5)] * 4 + [("a", None, 5), ("a", None, 4)], "a string, b long, c long")
    got = sorted((r["b"] or 0, r["c"], r["n"]) for r in ranks.ranked(df, ["a", "b"], ["c"], "n").collect())
    assert got == [(0, 4, 1), (0, 5, 2), (1, 5, 1), (1, 5, 2), (1, 5, 3), (1, 5, 4)]
    assert ranks.ranked(df.limit(0), ["a"], ["c"]).count() == 0
    assert sorted(r["position"] for r in ranks.ranked(df, [], ["c"]).collect()) == [1, 2, 3, 4, 5, 6]


def test_pages(spark, tmp_path):
    rows, df = sample(spark, 1003)
    path = str(tmp_path / "pages")
    ranks.write_pages(df, [F.asc_nulls_last("v"), "id"], path, size=10, block=8)
    index = spark.read.parquet(path)
    want = [r[3] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0.0, r[3]))]
    for page, at in ((0, 0), (57, 57), (100, 100), (101, 100), (10**6, 100), (-3, 0)):
        assert [r["id"] for r in ranks.read_page(index, page, block=8).collect()] == want[at * 10 : at * 10 + 10]
    plan = ranks.read_page(index, 57, block=8)._jdf.queryExecution().executedPlan().toString()
    assert "page_block#" in plan.split("PartitionFilters: [")[1].split("]")[0]
