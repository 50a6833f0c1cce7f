"""Quality scores (operator 5): histogram gradient-boosted trees over document statistics.

Statistics are computed on the executors; the trees are grown in numpy over a bounded sample of labelled documents, with
each statistic cut into quantile bins, and flattened into arrays in which a batch of documents walks all levels at once.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import held_out, labelled_sample, table, text_or_empty

#: Labelled documents the trees are grown on, at most.
SAMPLE = 20_000

STATISTICS = (
    "log_chars log_words mean_word letters upper lower digits blanks wide marks sentence_marks brackets pipes emphasis "
    "log_lines mean_line repeated_lines distinct_words top_word doubled_words marked_words longest_word capital_words byte_entropy"
).split()


def _classes() -> np.ndarray:
    """For each byte which of ten classes it counts to, as columns."""
    out = np.zeros((256, 10))
    for b in range(256):
        c = chr(b)
        out[b] = (
            b < 128 and c.isalpha(), b < 128 and c.isupper(), b < 128 and c.islower(), c.isdigit() and b < 128, c in " \t\n\r", b >= 128,
            33 <= b < 127 and not c.isalnum(), c in ".,;:?'", c in "()[]{}<>", c == "|",
        )
    return out


_CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The document statistics of one whole text; an empty text has zeros."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = bytes_of @ _CLASSES / len(raw)
    p = bytes_of[bytes_of > 0] / len(raw)
    words = text.split()
    n = len(words) or 1
    seen = Counter(words)
    lines = text.split("\n")
    unlike = len(set(lines))
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, *share, (bytes_of[33] + bytes_of[35:39].sum() + bytes_of[42]) / len(raw),
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - unlike / len(lines), len(seen) / n, max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(map(str.isalnum, words)) / n, np.log1p(max(map(len, seen), default=0)), sum(map(str.isupper, words)) / n, -(p * np.log2(p)).sum(),
    ]


class Trees:
    """Boosted trees of one depth, stored level by level: node k's children are 2k+1 and 2k+2 of its tree's row."""

    def __init__(self, base: float, edges: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.edges, self.feature, self.threshold, self.value = base, edges, feature, threshold, value

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Each row's probability of label 1: all rows walk all trees together, one level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Fit by logistic loss. Without rows, or with one label only, the score is the smoothed share of label 1."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, 0)), np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    n, k = x.shape
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
    code = np.stack([np.searchsorted(edges[:, j], x[:, j], "left") for j in range(k)], 1)  # x > edges[c - 1]
    flat = code + np.arange(k) * bins
    total, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    features, thresholds, values = (np.zeros((trees, m), t) for m, t in ((inner, np.int64), (inner, float), (leaves, float)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (k * bins) + flat).ravel()
            sums = [np.bincount(at, np.repeat(w, k), width * k * bins).reshape(width, k, bins).cumsum(2) for w in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature, split = np.where(good, best // bins, 0), np.where(good, best % bins, bins)
            first = width - 1
            features[t, first : first + width] = feature
            thresholds[t, first : first + width] = np.where(good, edges[np.minimum(split, bins - 2), feature], np.inf)
            node = 2 * node + (code[np.arange(n), feature[node]] > split[node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        values[t] = rate * gs / (hs + ridge)
        total += values[t][node]
    return Trees(base, edges, features, thresholds, values)


def with_statistics(docs: DataFrame, keep: str) -> DataFrame:
    """`docs` (text, keep) -> (keep, statistics ARRAY<DOUBLE>)."""
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(values, pa.list_(pa.float64()))], [keep, "statistics"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, statistics array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Grow the trees on at most `sample` labelled documents outside the held-out third; their statistics (a few numbers
    each) come to the driver, so what it holds is bounded by the parameter."""
    rows = with_statistics(labelled_sample(docs, labels, "quality", sample), "label").collect()
    x = np.array([r["statistics"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    y = np.array([r["label"] for r in rows], float)
    order = np.lexsort([*x.T, y])  # the order rows arrive in changes nothing
    return grow(x[order], (y[order] > 0).astype(float))


def scored(docs: DataFrame, model: Trees, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, predicted, *extra). Null text scores as empty. `extra` names columns
    of the documents to carry along; others are not read. One narrow pass; repeated rows give repeated results, an empty
    table an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    fields = [docs.schema["doc_id"], *(docs.schema[c] for c in extra)]
    source = "text" if "text" in extra else "_text"

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, source)
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(shared.value.probability(x), pa.float64())], [*(f.name for f in fields), "_score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = docs.select(*(f.name for f in fields), *([F.col("text").alias("_text")] if source == "_text" else [])).mapInArrow(run, f"{columns}, _score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), *extra)


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
