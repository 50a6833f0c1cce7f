"""Encoding and decoding of whole documents (operator 7)."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import broadcast_vocabulary, load, texts_of
from .common import table, text_or_empty


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids ARRAY<INT>): every whole text's token ids under the vocabulary file `path`.

    Null text counts as empty (no ids). Rows are independent: repeated rows give repeated results, and columns other
    than doc_id and text are not read. One narrow pass, no shuffle."""
    spec = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = load(path, spec)
        for batch in batches:
            ids = [pa.array(np.frombuffer(x, "<i4")) for x in bpe.encode_many(texts_of(batch))]
            ends = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Bytes that form no code point become U+FFFD; null ids count as none."""
    spec = broadcast_vocabulary(encoded.sparkSession, path)

    def run(batches):
        bpe = load(path, spec)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encode, then decode those ids, in one pass, so
    that ids, several times the size of the text, need not leave the worker. Nulls and repeats as in `encode`."""
    spec = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = load(path, spec)
        decimal = [str(i) for i in range(len(bpe.token_bytes))]
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for x in bpe.encode_many(texts_of(batch)):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                ids_hex.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
