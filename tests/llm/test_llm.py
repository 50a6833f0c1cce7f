"""The training-data operators: brute force on small tables, and each kind of odd input."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
xxhash = pytest.importorskip("xxhash")

from pyspark.sql import functions as F

from scoutlake.llm import bpe, chat, components, counts, embeddings, fingerprints, html, packing, quality, simhash, tokens, toxicity

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id long, text string"
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [None, "", " ", "one", "two words", "same text here again and again", "same text here again and again", LONG, "x" * 5000, "Ünï çødé 世界 🙂\n\ttabs", "<|endoftext|> a</s>"]


def odd_docs(spark, **extra):
    """Odd texts, with repeated and null ids and columns whose names operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("fingerprint", "score", "length", "sketch", "_text", "_y", "edits", "key", "label", "component_id", "n", "next_text", "_block"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---- operators 2, 7 and 4: token ids -------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoding_equals_the_library(path):
    own, lib = bpe.Bpe(open(path).read()), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "ab 's\t\n é世.!Σ1²\x1c  ́ÅfiIlLvVeE0"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4000)] + ["don't I'LL 's !'s ''s x's", "a  b   c \n\n d", "<|startoftext|><|endoftext|>x"]
    for text, ids in zip(texts, own.encode_many(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        if path == BYTES:
            assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    own = bpe.Bpe(open(BYTES).read())
    for token in own.token_bytes[:50_000]:
        assert not any(own.cut[a, b] for a, b in zip(token, token[1:]))
    text = "Some words, and more 世界; don't."
    assert b"".join(own.fragments(text)) == text.encode() and len(own.fragments(text)) > 5


def test_long_runs_and_windows(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 50)
    own, lib = bpe.Bpe(open(BYTES).read()), tokenizers.Tokenizer.from_file(BYTES)
    for text in ("word " * 200, "ab" * 700, "  \n x" * 100):
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    lib = tokenizers.Tokenizer.from_file(BYTES)
    docs = odd_docs(spark)
    got = sorted(map(tuple, tokens.round_trip(docs, BYTES).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tokens.round_trip(empty_docs(spark), BYTES).count() == 0
    few = docs.filter("length(text) < 100")
    back = tokens.decode(tokens.encode(few, BYTES), BYTES)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"]) for r in few.collect())


def recounted(lib, text):
    return len(lib.encode(text, add_special_tokens=False).ids)


def test_edits_are_counted_as_a_recount_would(spark):
    lib = tokenizers.Tokenizer.from_file(BYTES)
    rng = random.Random(3)
    texts = ODD + ["the quick brown fox jumps over " * 200] * 8 + ["世界，你好。再见！" * 900, "a\x1cb! \x1d c" * 50, "word, " * 30, "!? " * 100 + "\u3000x"]
    docs = spark.createDataFrame([*enumerate(texts)] + [(99, "no edits"), (99, "no edits"), (None, "no id")], DOCS).withColumn("tree", F.lit("clash")).repartition(3)

    def batch():
        rows = []
        for i, t in enumerate(texts):
            n = len(t or "")
            for k in range(4):
                rows.append((i, k, rng.randint(-3, n + 3), rng.choice([0, 1, 5, 700, n, None]), rng.choice(["", " ", "x", "'s", " new words and", "世界 " * 300, "many more words " * 900, None])))
        return rows + [(12345, 0, 1, 1, "nobody's"), (None, 0, 0, 0, "no id")]

    trees = counts.kept(counts.planted(docs, BYTES))
    now = {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in trees.collect() if r["doc_id"] in now} == {i: recounted(lib, t) for i, t in now.items()}
    for _ in range(3):  # later batches work on the trees of earlier ones
        edits = batch()
        frame = spark.createDataFrame(edits, "doc_id long, seq int, at long, removed long, added string").repartition(5)
        trees = counts.kept(counts.edited(counts.with_edits(trees, frame), BYTES).select("doc_id", "text", "tree", "n_tokens"))
        for i, _, at, removed, added in edits:
            if i in now:
                at = max(0, min(at, len(now[i])))
                now[i] = now[i][:at] + (added or "") + now[i][at + (removed or 0) :]
        got = {r["doc_id"]: r for r in trees.collect()}
        for i, t in now.items():
            assert (got[i]["text"], got[i]["n_tokens"]) == (t, recounted(lib, t))
            tree = counts.Tree.load(got[i]["tree"])
            again = counts.Tree(list(tree.chars[0]), list(tree.tokens[0]))
            assert (tree.chars, tree.tokens) == (again.chars, again.tokens) and sum(tree.chars[0]) == len(t)
        assert got[99]["text"] == "no edits" and got[None]["text"] == "no id" and trees.count() == len(texts) + 3
    one = counts.planted(spark.createDataFrame([(1, "some words here " * 5000)], DOCS), BYTES)
    one = counts.edited(one.withColumn("edits", F.expr(f"cast(array(struct(40000L, 3L, 'abc'), null) as array<{counts.EDIT}>)")), BYTES).first()
    assert one["reencoded_chars"] < 900 and one["n_edits"] == 2 and one["n_tokens"] == recounted(lib, one["text"])
    assert counts.edited(counts.planted(empty_docs(spark), BYTES).withColumn("edits", counts.first_edits()), BYTES).count() == 0


def test_only_sums_above_an_edit_change():
    tree = counts.Tree([10] * 37, [2] * 37)
    before = [list(x) for x in tree.tokens]
    tree.replace(20, [11, 0], [5, 0])
    assert [sum(a != b for a, b in zip(x, y)) for x, y in zip(before, tree.tokens)] == [2, 1, 1, 1, 1, 1, 1] and tree.total == 75
    assert counts.Tree.load(tree.kept()).tokens == tree.tokens and counts.leaves_of("") == [""]


def check_packing(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(used)


def test_packing_odd_texts(spark):
    lib = tokenizers.Tokenizer.from_file(WORDS)
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, WORDS).collect()
    check_packing(rows, 4096)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for doc_id, variants in texts.items():
        want = []
        for t in variants:
            ids = np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4")
            want += [(k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id) == sorted(want)
    assert packing.pack_documents(empty_docs(spark), WORDS).count() == 0


def one_by_one(lengths, capacity):
    """Best fit decreasing, a piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing_is_best_fit(spark):
    rng = random.Random(1)
    for lengths in ([rng.randint(1, 100) for _ in range(400)], [34] * 300 + [33, 67, 1, 1, 1], [100] * 5 + [1] * 250, [7]):
        parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        rows = packing.pack(parts, 100).collect()
        assert len(rows) == len(lengths) and check_packing(rows, 100) == one_by_one(lengths, 100)


# ---- operator 1 -----------------------------------------------------------------------------------------------------------


def test_sketches_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400, 4000]))) for _ in range(30)]
    texts[7] = texts[6]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r, a, b, c = rows[3 * i], shingles(t), shingles(edited), shingles(after)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, x, y in ((r["near_edited"], a, b), (r["near_next"], a, c)):
            exact = len(x) <= fingerprints.WHOLE and len(y) <= fingerprints.WHOLE
            assert abs(got - len(x & y) / len(x | y)) <= (1e-12 if exact else 0.1)
        assert abs(r["contained_in_edited"] - len(a & b) / len(a)) <= (1e-12 if len(a) <= fingerprints.WHOLE and len(b) <= fingerprints.WHOLE else 0.1)
        assert len(r["fingerprint"]) > 0
    assert rows[18]["near_next"] == 1.0 and rows[18]["fingerprint"] == rows[21]["fingerprint"]


def test_sketches_of_odd_texts(spark):
    rows = fingerprints.compared(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 3
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}
    assert len(same) == 1 and {r["fingerprint"] for r in rows if r["doc_id"] in (0, 1, 2)} == {""}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert all(r["contained_in_edited"] is None or 0 <= r["contained_in_edited"] <= 1 for r in rows)
    assert fingerprints.compared(empty_docs(spark)).count() == 0
    one = fingerprints.compared(spark.createDataFrame([(1, "only one document here today")], DOCS)).first()
    assert one["near_next"] == 1.0


def test_repeated_and_missing_ids_are_dealt_out(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(77, f"same id {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_tie", F.xxhash64("text"))
    placed = docs.withColumn("b", fingerprints._blocks(docs, "doc_id", "_tie")).collect()
    blocks = defaultdict(set)
    for r in placed:
        blocks[r["doc_id"]].add(r["b"])
    assert len(blocks[77]) > 3 and len(blocks[None]) > 10
    order = sorted(placed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["_tie"], r["text"]))
    assert [r["b"] for r in order] == sorted(r["b"] for r in order)
    got = {hashlib.sha256(r["edited_sha256"].encode()).hexdigest() for r in fingerprints.compared(docs).collect()}
    texts = [r["text"] for r in order]
    want = {hashlib.sha256(hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest().encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1])}
    assert got == want


def test_sketches_merge_and_contain(spark):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(3000)]
    pairs = []
    for n, m in ((2, 2000), (20, 2000), (150, 150), (200, 400), (1000, 3000)):
        for _ in range(20):
            long = [rng.choice(words) for _ in range(m)]
            at = rng.randrange(m - n - 4) if m > n + 4 else 0
            pairs.append((" ".join(long[at : at + n + 4]), " ".join(long)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ab", F.concat_ws(" ", "a", "b"))
    for c in ("a", "b", "ab"):
        df = fingerprints.with_sketch(df, c, f"s{c}")
    df = fingerprints.merged(df, "sa", "sb", "m")
    df = fingerprints.compared_by(df, "sa", "sb", "like", "inside")
    got = df.select("inside", "like", F.size(F.array_except("m.hashes", "sab.hashes")).alias("extra"), F.size(F.array_except("sab.hashes", "m.hashes")).alias("seam"), F.size("sa.hashes").alias("n")).collect()
    for r in got:  # each is wholly contained; nothing is said where no hash of the short one lies below the long one's bound
        assert r["inside"] in (1.0, None) and r["extra"] == 0 and r["seam"] <= 4
    assert all(r["n"] < 40 for r in got if r["inside"] is None) and sum(r["inside"] == 1.0 for r in got) >= 80


# ---- operators 3 and 6: links and groups -----------------------------------------------------------------------------------


def groups_of(n, linked):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)))
        label[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = groups_of(200, real)
    assert got == {i: want[i] for p in real for i in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # several blocks a bucket
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, *(base[:12] + rng.normal(size=(12, 24)) * s for s in (0.02, 0.1, 0.2, 0.25)), base[:1] + rng.normal(size=(60, 24)) * 0.05, base[:5], base[:3] * 7])
    x = x[rng.permutation(len(x))]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [float("inf")] + [0.0] * 23), (904, [None] * 24), (905, [1.0, 2.0]), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("key", F.lit("clash"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embeddings.COSINE
    np.fill_diagonal(near, False)
    want = groups_of(len(x), zip(*np.nonzero(near)))
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), want[i], want[i] == i), i
    for i in range(900, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_odd_texts(spark):
    docs = odd_docs(spark).filter("text is null or length(text) < 100000")
    rows = simhash.near_duplicates(docs).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(f"{plain_fingerprint(r['text']):016x}")
    assert len(rows) == docs.count()
    for r in rows:
        assert r["fingerprint"] in texts[r["doc_id"]]
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == by_id[6] == 5
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.one_of_each(docs.select("doc_id", "text")).collect()
    assert sum(r["doc_id"] == 5 for r in kept) == 1 and not any(r["doc_id"] in (1, 2, 6) for r in kept) and sum(r["doc_id"] is None for r in kept) == 2


@pytest.mark.parametrize("crowd", [32, 1])
def test_simhash_links_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:25]:  # chains and clusters of one to three flipped bits
        x = v
        for _ in range(rng.randint(1, 6)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            values.append(x)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    linked = [(i, j) for i in range(len(values)) for j in range(i) if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= 2]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "f long")).collect()
    at = {v: i for i, v in enumerate(values)}
    real = {frozenset(p) for p in linked}
    assert all(frozenset((at[r["a"]], at[r["b"]])) in real for r in found)
    assert groups_of(len(values), [(at[r["a"]], at[r["b"]]) for r in found]) == groups_of(len(values), linked)


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.uint64(1 << int(b)).view(np.int64)
        a, b = ({(i, v) for i, v in zip(*map(np.ndarray.tolist, simhash.anchors(z)))} for z in (x, y))
        assert {i for i, _ in a & b} == set(range(len(x)))


# ---- operators 5 and 9: classifiers -----------------------------------------------------------------------------------------


def labelled(spark, make, n=240):
    rng = random.Random(9)
    rows = [(i, *make(rng, i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    return docs, rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_documents(spark):
    def make(rng, i):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60)]
        return (" ".join(w.upper() + "!!" for w in words), 0) if i % 4 == 0 else (" ".join(words) + ".", 1)

    docs, rows = labelled(spark, make)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert all(out[i]["held_out"] == held(i) and out[i]["predicted"] == y == (out[i]["score"] >= 0.5) for i, _, y in rows)
    odd = quality.scored(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.scored(empty_docs(spark), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}


def test_held_out_labels_are_not_learned_from(spark):
    docs, rows = labelled(spark, lambda rng, i: ("good text here." if i % 2 else "BAD!! TEXT!!", i % 2))
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int")
    scores = [sorted(map(tuple, quality.scored(docs, quality.fit(docs, x)).collect())) for x in (a, b)]
    assert scores[0] == scores[1]


def test_toxicity_on_held_out_documents(spark):
    stems = ["vraxo", "thrumm", "gorbli"]

    def make(rng, i):
        words = ["".join(rng.choice(["la", "mi", "so", "te", "ru", "no"]) for _ in range(rng.randint(2, 4))) for _ in range(80)]
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(stems) + rng.choice(["", "la", "so", "tes"])
        return " ".join(words), int(i % 3 == 0)

    docs, rows = labelled(spark, make, 600)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    tested = [(out[i]["predicted"], y) for i, _, y in rows if held(i)]
    assert sum(p == y for p, y in tested) >= 0.97 * len(tested)
    assert model.word("vraxomi") > 3 * max(0, model.word("lamiso"))  # an unseen spelling
    odd = toxicity.scored(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.scored(empty_docs(spark), model).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


# ---- operator 8 -------------------------------------------------------------------------------------------------------------


def test_escapes_reverse():
    rng = random.Random(6)
    parts = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "|>", "\n", "x", "[\\INST]"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(2))
        segment, i, j = chat.render(role, text)
        assert chat.read_turn(segment) == (role, text) and chat.unescape(segment[i:j]) == text
        assert not any(c in segment[i:j] for c in chat.CONTROLS)


def test_logs_fold(spark):
    log = [(1, 0, 0, "open", "user", "hi"), (1, 0, 1, "delta", None, " there"), (1, 1, 0, "open", "assistant", "wrong"), (1, 1, 1, "regenerate", None, None), (1, 1, 2, "delta", None, "right"), (1, 1, 3, "delta", None, " answer"), (1, 0, 2, "edit", None, "hello"), (2, 0, 0, "open", None, None), (1, 2, 0, "unknown", "user", "?")]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq int, kind string, role string, text string").repartition(5)
    rows = chat.formatted(events).orderBy("conv_id", "turn").collect()
    assert [chat.read_turn(r["segment"]) for r in rows] == [("user", "hello"), ("assistant", "right answer"), ("user", ""), ("", "")]
    assert [r["loss_start"] is not None for r in rows] == [False, True, False, False]
    assert chat.formatted(events.limit(0)).count() == 0


def test_conversations_read_back(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 5, "assistant", "x\\y</s>"), (2, 2, "user", "[INST]"), (3, 0, "tool", "世界"), (3, 0, "tool", "世界"), (3, 0, "assistant", "b"), (6, 0, None, "twice"), (6, 0, None, "twice"), (None, 0, "user", "n"), (4, None, None, "m"), (5, 0, "assistant", LONG)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(chat.as_events(df))).collect()}
    want = defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t if t is not None else -1, r or "", x or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        orders = [ts] if c != 3 else [[ts[0], *ts[1:]], [*ts[1:], ts[0]], [ts[1], ts[0], ts[2]]]  # different turns of one number have no order
        assert got[c]["turns_sha256"] in {hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in o).encode()).hexdigest() for o in orders}
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] > sum(len(x) for _, _, x in ts)
    assert chat.digests(chat.formatted(chat.as_events(df.limit(0)))).count() == 0


# ---- operator 10 ------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><ul><li><a href=a>Home</a></ul></nav><article><h1>T &amp; U</h1><p><b>One  two<br>three.<p>Four&nbsp;five</p></article><footer>&copy; x</footer>", "T & U\nOne two three.\nFour five"),
    ("<body><div class='menu'><a href=x>Home</a> <a href=y>About us and more</a></div><div><h2>A title of some length</h2><p>First paragraph, with quite some text in it. It goes on.<p>Second one, also long enough; really.</div><div id=sidebar>Side, stuff. Long enough to count.</div>", "A title of some length\nFirst paragraph, with quite some text in it. It goes on.\nSecond one, also long enough; really."),
    ("<article><header><h1>T</h1></header><p>a <b>b</b><i>c</i> &am; e&#x41;<ul><li>one<li>two</ul><div class=comments><p>bad</div><form>no<input></form><table><tr><td>x<td>y</table><script>var a='<p>no</p>'</script></article>", "T\na bc &am; eA\none\ntwo\nx\ny"),
    ("<article><p class=it's>kept<p title='a>b'>too<p title=\"never closed>and this</article>", "kept\ntoo\nand this"),
    (None, ""), ("", ""), ("   ", ""), ("<!-- only a comment", ""), ("<script>x", ""), ("plain text only", "plain text only"), ("<p>" * 3000 + "deep", "deep"),
]


def test_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0]), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = html.extracted(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r["page_id"]][1] if r["page_id"] is not None else ""
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html.extracted(df.limit(0)).count() == 0


def test_long_pages_lose_nothing():
    body = "".join(f"<p>Paragraph {i}, with words. And more.</p>" for i in range(5000))
    assert html.main_text(f"<main>{body}</main>").count("\n") == 4999


# ---- the pipeline and the queries ---------------------------------------------------------------------------------------------


def test_pipeline_against_a_version_without_spark(spark):
    import os

    import corpus_pipeline
    from conftest import DATA

    sf = f"{DATA}/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r for r in labels.collect()}
    learn = sorted(i for i in marks if i in texts and not held(i))
    x, y = np.array([quality.statistics(texts[i]) for i in learn]), np.array([float(marks[i]["quality"]) for i in learn])
    order = np.lexsort([*x.T, y])
    trees = quality.grow(x[order], y[order])
    kept = [i for i in sorted(texts) if trees.probability(np.array([quality.statistics(texts[i])]))[0] >= 0.5]
    pairs = sorted((texts[i], int(marks[i]["toxic"])) for i in learn if i in set(kept))
    model = toxicity.train([t for t, _ in pairs], np.array([v for _, v in pairs]))
    kept = [i for i in kept if model.probability(texts[i], {}) < toxicity.THRESHOLD]
    prints = [plain_fingerprint(texts[i]) for i in kept]
    linked = [(a, b) for a in range(len(kept)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    top = groups_of(len(kept), linked)
    kept = [i for k, i in enumerate(kept) if top[k] == k]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted({r["doc_id"] for r in rows}) == kept
    check_packing(rows, 4096)
    lib = tokenizers.Tokenizer.from_file(WORDS)
    for i in kept[:40]:
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(lib.encode(texts[i], add_special_tokens=False).ids) + 1


def test_queries_have_the_contract_columns(spark):
    import os

    from conftest import DATA

    from scoutlake.llm.queries import QUERIES

    sf = f"{DATA}/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    want = {
        "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op3": "vec_id n_links component_id kept", "op4": "doc_id piece start length ids_crc32 sequence_id offset",
        "op5": "doc_id held_out score predicted", "op6": "doc_id fingerprint component_id", "op7": "doc_id n_tokens ids_sha256 decoded_sha256", "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9": "doc_id held_out score predicted", "op10": "page_id url text n_chars",
    }
    for name, columns in want.items():
        q = next(f for k, f in QUERIES.items() if k.startswith(name + "_"))
        assert set(columns.split()) <= set(q(spark, sf).columns), name
    assert json.dumps(sorted(QUERIES))
