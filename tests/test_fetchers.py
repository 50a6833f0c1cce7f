"""Users' fetchers over queries, users' feeds in batch and stream."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scoutlake.sources import fetchers as X


def test_fetchers_by_name_with_failures_as_rows(spark):
    def web(query, channel):
        for n in range(len(query)):
            yield {"title": query, "url": f"{channel}/{n}"}

    def broken(query, channel):
        yield {"title": "one", "url": "u"}
        raise OSError("gone")

    rows = spark.createDataFrame([(1, "a", "web", "xy"), (2, "b", "none such", "z"), (3, "c", "broken", "q"), (4, "d", None, None), (5, "e", "web", "")], "query_no long, channel string, fetcher string, query string")
    out = sorted((r.query_no, -1 if r.pos is None else r.pos, r.url, r.error) for r in X.fetched(rows, {"web": web, "broken": broken}, "web", batch=2).collect())
    assert out == [(1, 0, "a/0", None), (1, 1, "a/1", None), (2, 0, "b/0", None), (3, -1, None, "OSError: gone"), (3, 0, "u", None)]
    assert X.fetched(rows.limit(0), {"web": web}, "web").count() == 0
    with pytest.raises(ValueError):
        X.fetched(rows, {"web": web}, "other")


@pytest.fixture
def feed(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="feed-"), "ends.json")

    def ends(**n):
        with open(path, "w") as f:
            json.dump(n, f)

    X.register_feeds(spark)
    yield path, ends
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_feed_in_batch(spark, feed):
    path, ends = feed
    ends(a=2500, b=3, c=0)
    rows = spark.read.format("feed").option("feed", "tests.feeds_for_tests:Numbered").option("ends", path).option("channels", "a,b,c").load()
    assert rows.rdd.getNumPartitions() == 4  # three slices of a, one of b
    assert {(r.channel, r.n, r.last) for r in rows.groupBy("channel").agg(F.countDistinct("entry_no").alias("n"), F.max("entry_no").alias("last")).collect()} == {("a", 2500, 2499), ("b", 3, 2)}
    one = rows.filter("channel = 'b'")
    assert one.rdd.getNumPartitions() == 1 and [r.title for r in one.orderBy("entry_no").collect()] == ["b 0", "b 1", "b 2"]
    assert rows.filter("channel = 'c'").count() == 0


def test_feed_in_a_stream_that_is_restarted(spark, feed):
    path, ends = feed
    base = tempfile.mkdtemp(prefix="feed-stream-")

    def drain():
        rows = spark.readStream.format("feed").option("feed", "tests.feeds_for_tests:Numbered").option("ends", path).option("channels", "a,b").option("entries_per_task", 2).load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/at").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.channel, r.entry_no) for r in spark.read.parquet(f"{base}/out").collect())

    ends(a=5, b=0)
    assert drain() == [("a", n) for n in range(5)]
    ends(a=6, b=2)
    assert drain() == [("a", n) for n in range(6)] + [("b", 0), ("b", 1)]
