"""Positions within keys of any size, and pages of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved


def _key(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranked(rows: DataFrame, key: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """`rows` with their position, from 1, within `key` by `order`: any types, either direction, nulls where the order puts
    them. An empty key ranks all rows.

    Rows are range-sorted by key and order, so a key that holds a third of them lies in as many tasks as its share asks
    for. A row's position is its number within its range plus the key's rows in the ranges before. Only the key with which
    a range begins can have rows before it: these offsets are one row a range at most, and are broadcast. Ranges are taken from a sample, so what was dealt
    is saved before it is counted and numbered: a lost task cannot deal it anew. Equal sort keys stay in one range, in no
    defined order; end the order with an id to have it defined. Columns named _range, _from and _before may not occur."""
    # as many ranges as adaptive execution finds the rows worth, at most spark.sql.shuffle.partitions
    dealt = saved(rows.repartitionByRange(*(F.asc(k) for k in key), *map(_key, order)).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").select(*(F.col(k).alias(f"_key_{k}") for k in key), F.col("_range").alias("_from"), "_before")
    same = F.col("_range") == F.col("_from")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    own = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*map(_key, order)))
    out = dealt.withColumn(name, own).join(F.broadcast(offsets), same, "left")
    return out.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col(name)).cast("long").alias(name))


def write_pages(rows: DataFrame, order: list[str | Column], path: str, size: int = 10, block: int = 1000) -> None:
    """Write an index of pages: rows with `position` from 1, `page` from 0, in folders of `block` pages each. One range
    sort, once for each state of the table; pages are read with `read_page`."""
    at = F.floor((F.col("position") - 1) / size).cast("long")
    paged = ranked(rows, [], order).withColumn("page", at).withColumn("page_block", F.floor(F.col("page") / block).cast("long"))
    paged.repartition("page_block").sortWithinPartitions("page_block", "position").write.mode("overwrite").partitionBy("page_block").parquet(path)


def read_page(index: DataFrame, page: int, block: int = 1000) -> DataFrame:
    """A page of an index (`spark.read.parquet` of what write_pages wrote), in order; a number below 0 means the first page,
    one beyond the end the last. Nothing runs while the plan is built, and any page reads one folder of its block and the
    last folder, whose largest page is where numbers beyond the end go.

    An empty index has no page: write_pages then leaves no row behind, and the result is empty."""
    page = max(0, page)
    here = index.filter((F.col("page_block") == page // block) & (F.col("page") == page))
    last_block = index.select(F.max("page_block").alias("_last"))
    end = index.join(F.broadcast(last_block), F.col("page_block") == F.col("_last")).agg(F.max("page").alias("_page"))
    beyond = index.join(F.broadcast(last_block), F.col("page_block") == F.col("_last")).join(F.broadcast(end.filter(F.col("_page") < page)), F.col("page") == F.col("_page"))
    return here.unionByName(beyond.select(*index.columns)).orderBy("position").drop("page_block")
