"""The two classifiers against plain loops: growing and walking trees, training and scoring bags of n-grams."""

import math
from collections import Counter

import numpy as np
import pytest

from scoutlake.llm import quality, toxicity


def walked(trees, row):
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node, inner = 0, len(value) - 1
        while node < inner:
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += value[node - inner]
    return 1 / (1 + math.exp(-total))


def grown(x, y, trees, depth, bins, rate, least, ridge):
    """Each row's logit after boosting, every split tried on every node's rows."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
    total = [math.log((sum(y) + 1) / (len(y) - sum(y) + 1))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                part = lambda some: sum(g[i] for i in some) ** 2 / (sum(h[i] for i in some) + ridge)
                best, found = 1e-6, (rows, [])
                for j in range(x.shape[1]):
                    for edge in edges[:, j]:
                        left, right = [i for i in rows if x[i, j] <= edge], [i for i in rows if x[i, j] > edge]
                        if min(sum(h[i] for i in left), sum(h[i] for i in right)) < least * 0.05:
                            continue
                        gain = part(left) + part(right) - part(rows)
                        if gain > best + 1e-12:
                            best, found = gain, (left, right)
                below += found
            nodes = below
        for rows in nodes:
            value = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                total[i] += value
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 4))
    x[:, 3] = np.round(x[:, 3])  # equal values
    y = ((x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=150)) > 0).astype(float)
    model = quality.grow(x, y, trees=6, depth=3, bins=10, rate=0.2, least=4.0, ridge=1.0)
    want = [1 / (1 + math.exp(-t)) for t in grown(x, y, 6, 3, 10, 0.2, 4.0, 1.0)]
    assert np.allclose(model.probability(x), want, atol=1e-9)
    other = rng.normal(size=(300, 4)) * 2
    assert np.allclose(model.probability(other), [walked(model, r) for r in other], atol=1e-12)
    assert model.probability(np.zeros((0, 4))).tolist() == []


TEXTS = ["You are vile, VILE scum!", "vile words and scum again", "a calm note on rivers", "rivers and hills , a note", "scum of the hills", "calm and kind words", ""]
TOXIC = np.array([1, 1, 0, 0, 1, 0, 0])


def features(text):
    """Each n-gram's weight in the mean of a text's words."""
    words = [toxicity.plain(w) for w in text.split()]
    out = Counter()
    for w in words:
        g = toxicity.grams(w)
        for one in g:
            out[one] += toxicity.SCALE / (len(words) + toxicity.PADDING) / len(g)
    return out


def trained(texts, toxic, rounds, rate, decay, least, seed):
    """(vectors by n-gram, weights and bias; n-grams that tell the labels apart), one number after another."""
    size = range(toxicity.DIMENSIONS)
    rows = [features(t) for t in texts]
    n1, n0 = int(sum(toxic)), int(len(toxic) - sum(toxic))
    used = set()
    for gram in set().union(*rows):
        in1, in0 = (sum(gram in r for r, y in zip(rows, toxic) if y == side) for side in (1, 0))
        p = (in1 + in0 + 1) / (n1 + n0 + 2)
        if abs(in1 / n1 - in0 / n0) >= least * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)):
            used.add(gram)
    start = np.random.default_rng(seed).normal(0, 0.5, (toxicity.DIMENSIONS, 2)).astype(np.float32)
    now = {("e", g, k): 0.0 for g in used for k in size} | {("w", k, c): float(start[k, c]) for k in size for c in (0, 1)} | {("b", 0): 0.0, ("b", 1): 0.0}
    m, v = dict.fromkeys(now, 0.0), dict.fromkeys(now, 0.0)
    for step in range(1, rounds + 1):
        slope = dict.fromkeys(now, 0.0)
        for row, y in zip(rows, toxic):
            mean = [sum(x * now["e", g, k] for g, x in row.items() if g in used) for k in size]
            raw = [math.exp(sum(mean[k] * now["w", k, c] for k in size) + now["b", c]) for c in (0, 1)]
            cost = 0.5 / n1 if y else 0.5 * toxicity.CLEAN_COST / n0
            error = [(raw[c] / sum(raw) - (c == y)) * cost for c in (0, 1)]
            for c in (0, 1):
                slope["b", c] += error[c]
                for k in size:
                    slope["w", k, c] += mean[k] * error[c]
            for g, x in row.items():
                for k in size if g in used else ():
                    slope["e", g, k] += x * sum(error[c] * now["w", k, c] for c in (0, 1))
        for at in now:
            d = slope[at] + (decay * now[at] / len(used) if at[0] == "e" else 0.0)
            m[at], v[at] = 0.9 * m[at] + 0.1 * d, 0.99 * v[at] + 0.01 * d * d
        now = {at: now[at] - rate * (m[at] / (1 - 0.9**step)) / (math.sqrt(v[at] / (1 - 0.99**step)) + 1e-9) for at in now}
    return now, used


@pytest.mark.parametrize("least", [0.0, 1.2])
def test_bags_of_ngrams(least):
    model = toxicity.train(TEXTS, TOXIC, rounds=6, least=least, seed=3)
    now, used = trained(TEXTS, TOXIC, 6, 0.1, 1e-3, least, 3)
    assert used and {int(g) for g in np.nonzero(np.abs(model.vectors).sum(1))[0]} == used
    for text in [*TEXTS, "Vi1e scumm unseen", "rivers " * 500]:
        row = features(text)
        raw = [math.exp(sum(sum(x * now["e", g, k] for g, x in row.items() if g in used) * now["w", k, c] for k in range(toxicity.DIMENSIONS)) + now["b", c]) for c in (0, 1)]
        assert model.probability(text, {}) == pytest.approx(raw[1] / sum(raw), abs=1e-4)


def test_one_label_only():
    assert toxicity.train(["a", "b"], np.array([0, 0])).probability("anything", {}) == pytest.approx(0.25)
    assert quality.grow(np.zeros((2, 3)), np.ones(2)).probability(np.zeros((1, 3)))[0] == pytest.approx(0.75)
