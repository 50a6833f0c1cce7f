"""The corpus pipeline: quality filter, toxicity filter, near-duplicate removal, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
a DataFrame, written as Parquet and read again before the next. All but the last return the columns of `documents`.

Every stage takes nulls in any column (a null text counts as empty, a null id names nobody), empty and very long texts,
repeated rows and columns beside those of `documents`, which it leaves out. An empty table gives an empty one, and without
labels a classifier scores by its prior alone."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoutlake.llm import packing, quality, simhash, toxicity
from scoutlake.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 5): score 0.5 or more. Rows that repeat stay or go
    together; an empty text is scored like any other."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, extra=tuple(COLUMNS[1:])).filter("predicted = 1").select(COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (operator 9): score below 0.7. It learns from the labelled
    documents that are left; without any, nothing is rejected."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, extra=tuple(COLUMNS[1:])).filter("predicted = 0").select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6), the one of the smallest id. Empty texts are one group;
    rows of one id are one document; rows without an id belong to no group and stay."""
    return simhash.one_of_each(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences (operator 4); an empty text is a piece of one token."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("toxicity", toxicity_filter), ("near_duplicates", simhash_dedup), ("packing", pack)]
#: Trained models and tokenisers are beyond SQL; tests hold the pipeline against a version without Spark.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again. A stage's rows are
    removed when the next stage's are written; the last ones stay, since the result may be computed again from them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    written = ""
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            if written:
                _remove(spark, written)
            written = path
            docs = spark.read.parquet(path)
    return docs
