"""What the operators of this subpackage share: table access, lineage cuts, stable hold-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import saved, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder, so that lost executors cost no recomputation of
    what came before."""
    return saved(df)


def joined(rows: DataFrame, lookup: DataFrame, key: list[str], hot: Column) -> DataFrame:
    """Inner join of `rows` with one row of `lookup` per key. Keys for which `hot` holds, by their count more than a
    thousandth of all rows and so fewer than a thousand, are broadcast: their rows stay where they are."""
    few = F.broadcast(lookup.filter(hot))
    rest = rows.join(few.select(*key), key, "left_anti").join(lookup.filter(~hot), key)
    return rows.join(few, key).unionByName(rest)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """The third of the documents no classifier may learn from: crc32 of the id's decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, even: bool = False) -> DataFrame:
    """(text, label) of at most `bound` labelled rows outside the held-out third, chosen by a hash of the id; with `even`
    at most half of them of either label.

    The bound keeps what reaches the driver independent of the corpus; scoring never depends on it. Rows with a
    null label or id are left out, repeated label rows of one document count once (the larger label)."""
    ids = (
        labels.select("doc_id", (F.col(label) > 0).cast("int").alias("_y"))
        .filter(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("_y").alias("_y"))
    )
    chosen = [ids.filter(F.col("_y") == y) for y in (0, 1)] if even else [ids]
    chosen = [x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // len(chosen)) for x in chosen]
    # bounded by the parameter: at most `bound` pairs of numbers
    few = F.broadcast(chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", text_or_empty()).join(few, "doc_id").select("text", F.col("_y").alias("label"))
