"""Best-fit packing of token sequences (operator 4), in bulk-synchronous rounds.

Pieces are range-sorted by length; all pieces of one length are placed in one round, longest first. In a round the sorted
gaps are swept from the smallest that holds the length (its successor) upwards, pieces meet gaps in the order of their
ranks, so no two pieces want the same place, and the gaps shrink before the next round. Lengths and gaps are whole numbers
up to the capacity, so both sorted lists are kept as runs: the sweep works on as many rows as there are lengths and runs
of gaps (a bound set by the capacity, not by the corpus), while ranking the pieces and placing them run on the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import broadcast_vocabulary, load, texts_of
from .common import cut, shuffle_partitions, table, text_or_empty

CAPACITY = 4096
#: The id after each document.
SEPARATOR = 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32): every document's ids and the separator, cut into
    pieces of `capacity` ids; the last may be shorter. Null or empty text gives one piece, the separator."""
    spec = broadcast_vocabulary(docs.sparkSession, path)
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        bpe = load(path, spec)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_many(texts_of(batch))):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            out = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, first sequence, offset there, pieces a sequence).

    The piece of rank r from a row's first rank on goes to sequence `first + (r - rank) // k` at
    `offset + (r - rank) % k * length`. A gap that holds several pieces of one length takes them before a wider gap is
    touched, as placing them one by one would have it."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    gaps: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                insort(gaps, gap)
            runs[gap].append((first, count))

    def fill(length: int, rank: int, left: int, gap: int, first: int, count: int) -> int:
        """Place up to `left` pieces into `count` sequences with this gap; how many found a place."""
        k = gap // length
        full = min(count, left // k)
        rest = left - full * k if full < count else 0
        placed = full * k + rest
        plan.append((length, rank, first, capacity - gap, k))
        leave(gap - k * length, first, full)
        if rest:
            leave(gap - rest * length, first + full, 1)
        leave(gap, first + full + (rest > 0), count - full - (rest > 0))
        return placed

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps.pop(at)
            for first, count in (waiting := runs.pop(gap)):
                if left:
                    placed = fill(length, rank, left, gap, first, count)
                    left, rank = left - placed, rank + placed
                else:
                    leave(gap, first, count)
            del waiting
        if left:
            count = -(-left // (capacity // length))
            fill(length, rank, left, capacity, opened, count)
            opened += count
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length, ...) with 1 <= length <= capacity -> the same rows with (sequence_id, offset).

    Repeated rows are packed as often as they come; an empty table gives an empty one. Pieces of one length are ranked
    by (doc_id, piece) over sorted ranges of them, so a length that a third of all pieces share spreads over tasks.
    What comes to the driver are counts per (range, length): ranges plus lengths many, for ranges follow lengths."""
    spark = parts.sparkSession
    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranged = cut(parts.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", "length").count().collect()
    histogram: dict[int, int] = defaultdict(int)
    start: dict[tuple[int, int], int] = {}
    for r in sorted(counts):
        start[r["_range"], r["length"]] = histogram[r["length"]]
        histogram[r["length"]] += r["count"]
    plan = best_fit(histogram, capacity)
    bounds = {n: np.searchsorted(-plan[:, 0], [-n, -n + 1]) for n in histogram}
    shared = spark.sparkContext.broadcast((plan, bounds, start))

    def place(batches):
        plan, bounds, start = shared.value
        met: dict[tuple[int, int], int] = {}
        for batch in batches:
            lengths, ranges = batch.column("length").to_numpy(), batch.column("_range").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            edges = np.flatnonzero(np.diff(lengths)) + 1  # sorted: each length is one stretch
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)]):
                if i == j:
                    continue
                key = int(ranges[i]), int(lengths[i])
                rank = start[key] + met.get(key, 0) + np.arange(j - i)
                met[key] = met.get(key, 0) + j - i
                rows = plan[slice(*bounds[key[1]])]
                row = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
                past = rank - row[:, 1]
                sequence[i:j] = row[:, 2] + past // row[:, 4]
                offset[i:j] = row[:, 3] + past % row[:, 4] * key[1]
            columns = [c for c in batch.schema.names if c != "_range"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields]
    return ranged.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    # tokens are counted once: sorting into ranges would otherwise read the texts twice
    return pack(cut(pieces(docs, path, capacity)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
