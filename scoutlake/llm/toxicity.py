"""Toxicity scores (operator 9): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed) and itself; a document is the mean of its words' vectors; a linear
softmax tells toxic from clean. Unseen spellings share n-grams, and so vectors, with the words they were made from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import held_out, labelled_sample, table, text_or_empty

#: Labelled documents the vectors are trained on, at most; half of them of each label if there are as many.
SAMPLE = 4_000
#: Labelled documents of more characters are not learned from: with SAMPLE this bounds what the driver holds.
LONGEST = 50_000
BUCKETS = 1 << 17
DIMENSIONS = 6
SIZES = (3, 4, 5)
#: The softmax sees the mean vector times this: a few words of hundreds must be able to decide.
SCALE = 100.0
THRESHOLD = 0.7
#: Empty words every text is taken to have besides its own, so that one odd word of a short text decides less.
PADDING = 20
#: What a clean text called toxic costs against a toxic one missed.
CLEAN_COST = 4.0
#: Standard errors by which an n-gram's shares of toxic and clean texts must differ.
TELLING = 6.5
#: Words whose scores a task keeps; memory only, never results.
CACHE_WORDS = 300_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&-_|/\\"


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def grams(word: str) -> list[int]:
    """The hashed n-grams of a word between its two marks, and the word itself. No word, no grams."""
    if not word:
        return []
    marked = f"<{word}>"
    pieces = {marked, *(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))}
    return [zlib.crc32(p.encode()) % BUCKETS for p in pieces]


class Model:
    """Vectors of the n-grams, the softmax's weights and its bias; for two labels the softmax is a logistic function of
    the weights' difference, so a word's share in a document's score is one number."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.gram_score = (SCALE * vectors @ (weights[:, 1] - weights[:, 0])).tolist()
        self.prior = float(bias[1] - bias[0])

    def word(self, word: str) -> float:
        g = grams(plain(word))
        return sum(map(self.gram_score.__getitem__, g)) / len(g) if g else 0.0

    def probability(self, text: str, seen: dict[str, float]) -> float:
        words = text.split()
        got = [*map(seen.get, words)]
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    if (x := seen.get(w)) is None:
                        x = seen[w] = self.word(w)
                    got[i] = x
        logit = sum(got) / (len(got) + PADDING) + self.prior
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def telling(gram: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: float) -> np.ndarray:
    """The n-grams found in a share of the toxic texts that differs from their share of the clean ones by `least`
    standard errors or more. The others only add noise to the mean, and texts of few words are most open to it."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    in1, in0 = (np.bincount(gram[chosen], minlength=BUCKETS) for chosen in (toxic[doc], ~toxic[doc]))
    p = (in1 + in0 + 1) / (n1 + n0 + 2)
    return np.abs(in1 / n1 - in0 / n0) >= least * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def train(texts: list[str], labels: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, least: float = TELLING, seed: int = 7) -> Model:
    """Joint training of vectors and softmax on whole texts, full-batch with Adam. N-grams that do not tell them apart stay at zero. Without both labels the score is the smoothed share of toxic ones."""
    return train_bags([bag(t) for t in texts], labels, rounds, rate, decay, least, seed)


def bag(text: str) -> Counter:
    """The words of a whole text, as their n-grams see them, and how often each comes."""
    return Counter(map(plain, text.split()))


def train_bags(bags: Iterable[Counter], labels: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, least: float = TELLING, seed: int = 7) -> Model:
    """`train` on documents' words."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    weights = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.log(np.array([1 - share, share], np.float32))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(vectors, weights, bias)
    of_word: dict[str, np.ndarray] = {}
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for words in bags:
        for w in words:
            if w not in of_word:
                of_word[w] = np.array(grams(w), np.int32)
        lists = [*map(of_word.__getitem__, words)]
        portion = np.fromiter(words.values(), float) / (words.total() + PADDING)
        weight = np.repeat(portion / np.maximum(1, [*map(len, lists)]), [*map(len, lists)])
        ids, inverse = np.unique(np.concatenate([np.zeros(0, np.int32), *lists]), return_inverse=True)
        rows.append((ids, np.bincount(inverse, weight, len(ids))))
    size = np.array([len(ids) for ids, _ in rows])
    doc, gram, x = np.repeat(np.arange(len(rows)), size), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]) * SCALE
    toxic = labels > 0
    known = telling(gram, doc, toxic, least)
    doc, gram, x = (a[known[gram]] for a in (doc, gram, x))
    used, gram = np.unique(gram, return_inverse=True)
    if not len(used):
        return Model(vectors, weights, bias)
    cost = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 * CLEAN_COST / max(1, (~toxic).sum()))[:, None]
    want = np.stack([~toxic, toxic], 1)
    parts = [np.zeros((len(used), DIMENSIONS)), weights.astype(float), np.zeros(2)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        e, w, b = parts
        mean = np.stack([np.bincount(doc, x * e[gram, k], len(rows)) for k in range(DIMENSIONS)], 1)
        logits = mean @ w + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - want) * cost
        back = error @ w.T
        to_gram = np.stack([np.bincount(gram, x * back[doc, k], len(used)) for k in range(DIMENSIONS)], 1) + decay * e / len(used)
        for k, g in enumerate((to_gram, mean.T @ error, error.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            parts[k] = parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    vectors[used] = parts[0]
    return Model(vectors, parts[1], parts[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Train on at most `sample` labelled documents outside the held-out third, whole texts of up to `longest` characters.
    Their words are counted on the executors; the counts come to the driver, so the two parameters bound what it holds."""
    rows = labelled_sample(docs.filter(F.length("text") <= longest), labels, "toxic", sample, even=True)

    def run(batches):
        for batch in batches:
            bags = [sorted(bag(t).items()) for t in texts_of(batch)]  # words hold no space
            words, counts = [" ".join(w for w, _ in b) for b in bags], [np.array([n for _, n in b], "<i4").tobytes() for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.string()), pa.array(counts, pa.binary())], ["label", "words", "counts"])

    found = rows.mapInArrow(run, "label int, words string, counts binary").collect()
    found = sorted((r["words"], bytes(r["counts"]), r["label"]) for r in found)  # the order rows arrive in changes nothing
    bags = (Counter(dict(zip(w.split(" "), np.frombuffer(n, "<i4").tolist()))) for w, n, _ in found)
    return train_bags(bags, np.array([int(y > 0) for _, _, y in found]))


def scored(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, held_out, score, predicted, *extra). Null text scores as empty, by the prior alone.
    `extra` names columns of the documents to carry along. One narrow pass; repeated rows give repeated results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS vectors, whatever the corpus
    fields = [docs.schema["doc_id"], *(docs.schema[c] for c in extra)]
    source = "text" if "text" in extra else "_text"

    def run(batches):
        model, seen = shared.value, {}  # the table of words goes with the task
        for batch in batches:
            p = []
            for t in texts_of(batch, source):
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                p.append(model.probability(t, seen))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(p, pa.float64())], [*(f.name for f in fields), "_score"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = docs.select(*(f.name for f in fields), *([F.col("text").alias("_text")] if source == "_text" else [])).mapInArrow(run, f"{columns}, _score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), *extra)


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
