"""Operator 13 against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scoutlake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain(rows, least, top):
    docs = [(text or "", lang or "", source or "") for text, lang, source in rows]
    df, of, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = terms(text)
        df[lang].update(set(found))
        of[lang, source].update(found)
        langs[lang].update(found)
    out = []
    share = lambda count, n, v: 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in of:
        kept = [t for t, n in df[lang].items() if n >= least]
        total = lambda c, kept=kept: sum(c[t] for t in kept)
        p = {t: share(of[lang, source][t], total(of[lang, source]), len(kept)) for t in kept}
        q = {t: share(langs[lang][t], total(langs[lang]), len(kept)) for t in kept}
        pairs = []
        for other_lang, other in of:
            if other_lang == lang and other != source:
                o = {t: share(of[lang, other][t], total(of[lang, other]), len(kept)) for t in kept}
                pairs.append((-sum(f(p[t], o[t]) for t in kept), other.encode(), other))
        words = [(-f(p[t], q[t]), t.encode(), t) for t in kept if of[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def table(n, seed, sources=7, hot=False):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "beta", "gamma-delta", "été", "ÉTÉ", "longlongword", "longlongwords", "longlongworda", "longlong", "a", "b", "\U0001f600x", "日本語", "x" * 40, "x" * 41, "don't", "1a2b"]
    rows = []
    for i in range(n):
        source = "hot" if hot and i % 3 == 0 else f"s{draw.randrange(sources)}"
        text = draw.choice([" ", "\n", "."]).join(draw.choices(words, k=draw.randint(0, 12)))
        rows.append((draw.choice([text, text, text, None]) if i % 17 == 0 else text, draw.choice(["en", "de", None, "xx"]), draw.choice([source] * 9 + [None, ""])))
    return rows + rows[:20] + [("", "none", "a"), (None, "none", "b"), ("rare", "none", "b")]


@pytest.mark.parametrize("block", [64, 3])
def test_whole_jobs(spark, block, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", block)
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (block,))
    monkeypatch.setattr(divergence, "STEP", 4)
    rows = table(400, block, hot=True)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, count int").repartition(5)
    assert sorted(map(tuple, divergence.audited(df, 3, 5).collect())) == plain(rows, 3, 5)


@pytest.mark.parametrize("step", [2048, 1])
def test_words_that_no_source_of_a_block_has(spark, monkeypatch, step):
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (2,))
    monkeypatch.setattr(divergence, "STEP", step)
    rows = [(f"own{'abcdefg'[s]} " * (s + 1) + f"mine{'abcdefg'[s]} common", lang, f"s{s}") for s in range(7) for lang in ("en", "de") for _ in range(3)]
    rows += [("rare", "en", "silent"), (None, "none", "a"), ("rare", "none", "b"), ("", "none", "c")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert sorted(map(tuple, divergence.audited(df, 3, 5).collect())) == plain(rows, 3, 5)


def test_empty_table_and_one_source(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audited(empty).count() == 0
    one = [("word " * 3, "en", "only")] * 12
    assert sorted(map(tuple, divergence.audited(spark.createDataFrame(one, empty.schema)).collect())) == plain(one, 10, 10)


def test_slices_give_the_same_counts(spark):
    rows = table(200, 9) + [("z" * 70_000 + " end " + "Y" * 9, "en", "s0")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    whole, cut = ({tuple(r) for r in divergence.word_counts(df.coalesce(1), b).groupBy("lang", "term", "source").sum("count", "documents").collect()} for b in (1 << 30, 1))
    assert whole == cut


def test_pointers_sort_as_words_do():
    draw = random.Random(2)
    texts = ["".join(draw.choice(["a", "b", "A", "é", " ", "日", "-"]) for _ in range(draw.randint(0, 50))) for _ in range(300)] + ["ab" * 30, "ab" * 30 + "c", "abababab", "", "ABABABAB ababababab"]
    array = pa.array(["skipped", *texts], pa.large_string())[1:]  # a slice, whose buffers start elsewhere
    data = np.frombuffer(array.buffers()[2], np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    at, length, text = divergence.word_pointers(data, offsets)
    low = np.concatenate([divergence._LOWER[data], np.zeros(8, np.uint8)])
    words = [low[a : a + n].tobytes() for a, n in zip(at, length, strict=True)]
    assert words == [w.encode() for t in texts for w in terms(t)] and list(text) == [i for i, t in enumerate(texts) for _ in terms(t)]
    order, head = divergence.sorted_pointers(low, at, length)
    assert list(order) == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert list(head) == [i == 0 or words[order[i]] != words[order[i - 1]] for i in range(len(order))]
