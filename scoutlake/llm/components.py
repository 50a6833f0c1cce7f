"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import groups


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node reachable, for every node that has a link to another. Links may
    repeat, point either way or to the node itself; nulls are dropped."""
    found = groups(links.select(F.col("a").alias("left"), F.col("b").alias("right")))
    return found.select(F.col("id").alias("node"), F.col("canonical").alias("component"))
