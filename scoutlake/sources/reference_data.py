"""Reference data and report sinks: channels, the fund's thesis, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enabled(channels: DataFrame) -> DataFrame:
    return channels.filter("enabled").orderBy("name")


def default_thesis(theses: DataFrame, builtin: DataFrame) -> DataFrame:
    """The thesis marked as default, the built-in one if none is: one row (the feature is to have one)."""
    marked = theses.filter("is_default").withColumn("_rank", F.lit(0))
    return marked.unionByName(builtin.withColumn("_rank", F.lit(1)), allowMissingColumns=True).orderBy("_rank", "thesis_id").limit(1).drop("_rank")


def updated_thesis(theses: DataFrame, update: DataFrame) -> DataFrame:
    """All theses with the default one replaced by the update, which becomes the default if there was none."""
    return theses.filter("not is_default").unionByName(update.withColumn("is_default", F.lit(True)), allowMissingColumns=True)


def missing_rows(target: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows that the target lacks; running it again adds nothing."""
    return seed.join(target.select(key), key, "left_anti")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, replacing an earlier one at that path."""
    rows.write.mode("overwrite").json(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """A dimension after a replacement: the new rows alone, in the old one's columns."""
    return new.select(old.columns)
