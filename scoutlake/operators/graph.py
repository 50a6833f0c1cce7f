"""Groups of linked ids: every id gets the smallest id that links lead to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, one machine
    takes a temporary folder of its own; a cluster, whose executors could not see it, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scoutlake-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df` materialised in the session's shared checkpoint folder, which lost executors do not take with them."""
    shared_folder(df.sparkSession)
    return large(df.checkpoint(eager=True))


def large(df: DataFrame) -> DataFrame:
    """`df` for joins on either side by sort and merge, unless the other side is marked for broadcast.

    Spark takes a plan's size from the compressed bytes of its files, and neither an explode nor a text computed from a number
    makes it larger: a million people would count as a few MB and pass through the driver as a broadcast."""
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for joins as `large` has them: read by column, and a fraction of a
    checkpoint's size, which holds rows one by one. For tables that grow with the input; `saved` is for small steps, and
    for columns without a type, which Parquet has no form for."""
    if "void" in df.schema.simpleString():
        return saved(df)
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return large(df.sparkSession.read.schema(df.schema).parquet(path))


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, known when a query is planned: joins with them fall away."""
    return spark.createDataFrame([], schema).limit(0)


def _stars(edges: DataFrame) -> DataFrame:
    """One round over links (a > b): every larger end of a link is hung on the least smaller neighbour of its smaller end,
    then every node and its smaller neighbours on the least of these.

    A node without smaller neighbours, the centre of a finished star, is no key of the first join's right side: its links
    pass as they are. A centre of many links is a skewed key on the left side of a join, where adaptive execution splits it."""
    low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    large = edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def groups(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(left, right) -> (id, canonical) for all ids linked to another one.

    Links may repeat, point either way or to the id itself; nulls are dropped. All rounds are joins and partial aggregates
    over links; the driver sees one count and one checksum a round. Rounds grow with the logarithm of the longest chain."""
    pairs = links.filter("left is not null and right is not null and left <> right")
    edges = saved(pairs.select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    before = mark(edges)
    for _ in range(most_rounds):
        edges = saved(_stars(edges))
        after = mark(edges)
        if after == before:
            return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("canonical")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("canonical")).distinct())
        before = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
