"""Edit-aware token counts (operator 2): segment trees over pre-tokens, kept with each document.

A document's text is cut into leaves of up to PRETOKENS pre-tokens that end where every pre-tokeniser begins anew. Its tree
holds each leaf's length and token count and, above them, sums over pairs of neighbours. Trees are kept as a column beside
the text, so that a batch of edits starts from the trees that the batch before it left. An edit encodes the leaves that it
touches, plus those whose boundary it may have removed, and changes the sums on their paths to the root: leaves take up what
an edit adds and become empty where it removes all, and only a leaf grown beyond GROWN characters has its tree dealt anew.
"""

from __future__ import annotations

import re
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_FRAGMENTS, SPACE, broadcast_vocabulary, load
from .common import shared_folder, table, text_or_empty

#: Pre-tokens of a leaf, and the characters beyond which a leaf is split where it can be.
PRETOKENS, GROWN = 40, 4096
# Boundaries to the pre-tokeniser whatever is around them: before white space after anything else, and between one of these
# marks and a letter (texts without spaces).
_LEAF = re.compile(rf"(?:[{SPACE}]*+[^{SPACE}]++){{{PRETOKENS}}}(?=[{SPACE}])")
_GAP = re.compile(rf"[^{SPACE}](?=[{SPACE}])|[。，、！？；：](?=[^\W\d_])")

#: Fragments a worker keeps for edits: two batches of them in a row mean two workers to a task.
KEEP = 150_000
EDIT = "struct<at: long, removed: long, added: string>"


def leaves_of(text: str) -> list[str]:
    """The text in leaves of PRETOKENS pre-tokens, the last one with fewer; long ones split further where they can be."""
    out, begin = [], 0
    while m := _LEAF.match(text, begin):
        out.append(text[begin : m.end()])
        begin = m.end()
    if begin < len(text) or not out:
        out.append(text[begin:])
    if max(map(len, out)) > GROWN:
        out = [part for leaf in out for part in _split(leaf)]
    return out


def _split(leaf: str) -> list[str]:
    out, begin = [], 0
    while len(leaf) - begin > GROWN and (m := _GAP.search(leaf, begin + GROWN // 4)):
        out.append(leaf[begin : m.end()])
        begin = m.end()
    return [*out, leaf[begin:]]


class Tree:
    """Sums over a list of leaves: chars[0] and tokens[0] the leaves', each further level pairs of the one below."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = [chars], [tokens]
        for levels in (self.chars, self.tokens):
            while len(below := levels[-1]) > 1:
                levels.append([a + b for a, b in zip(below[::2], [*below[1::2], 0])])

    @classmethod
    def load(cls, kept: bytes) -> Tree:
        """A tree as `kept` gave it: the number of leaves, then the levels."""
        numbers = array("i", kept).tolist()
        tree, at, n = cls.__new__(cls), 1, numbers[0]
        tree.chars, tree.tokens = [], []
        while True:
            tree.chars.append(numbers[at : at + n])
            tree.tokens.append(numbers[at + n : at + 2 * n])
            at += 2 * n
            if n <= 1:
                return tree
            n = (n + 1) // 2

    def kept(self) -> bytes:
        out = array("i", [len(self.chars[0])])
        for c, t in zip(self.chars, self.tokens):
            out.extend(c)
            out.extend(t)
        return out.tobytes()

    @property
    def total(self) -> int:
        return self.tokens[-1][0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one with any for the text's end), and the characters before it."""
        i, before = 0, 0
        for level in self.chars[-2::-1]:
            i *= 2
            if at >= before + level[i] and i + 1 < len(level):
                before += level[i]
                i += 1
        return i, before

    def replace(self, i: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves from i on become these; only the sums above them change."""
        j = i + len(chars)
        self.chars[0][i:j], self.tokens[0][i:j] = chars, tokens
        for levels in (self.chars, self.tokens):
            a, b = i, j
            for k in range(1, len(levels)):
                below = levels[k - 1]
                a, b = a // 2, (b - 1) // 2 + 1
                for n in range(a, b):
                    levels[k][n] = below[2 * n] + (below[2 * n + 1] if 2 * n + 1 < len(below) else 0)


def _shared_out(parts: list[str], n: int) -> list[str]:
    """A region's new leaves as n: the last ones together where there are more, empty ones where there are fewer."""
    if len(parts) > n:
        return [*parts[: n - 1], "".join(parts[n - 1 :])]
    return parts + [""] * (n - len(parts))


def touched(text: str, tree: Tree, at: int, removed: int, added: str) -> tuple[str, int, int, list[str]]:
    """The edited text and what the edit touches: leaves i to j of the tree and the new leaves in their place, as many, or
    more where one would have grown too long."""
    at = max(0, min(at, len(text)))
    stop = min(len(text), at + max(0, removed))
    sizes = tree.chars[0]
    i, begin = tree.find(at)
    j, end = tree.find(max(at, stop - 1))
    end += sizes[j]
    j += 1
    while j < len(sizes) and (stop == end or not sizes[j - 1]):  # the boundary after the edit may be gone: take in the next leaf
        end += sizes[j]
        j += 1
        if sizes[j - 1]:
            break
    while i and at == begin:  # and so may the one before it
        i -= 1
        begin -= sizes[i]
        if sizes[i]:
            break
    fresh = leaves_of(text[begin:at] + added + text[stop:end])
    parts = _shared_out(fresh, j - i)
    return text[:at] + added + text[stop:], i, j, fresh if max(map(len, parts)) > GROWN and len(fresh) > j - i else parts


def settled(tree: Tree, i: int, j: int, chars: list[int], tokens: list[int]) -> Tree:
    """The tree with these leaves for i to j: the same one with the sums above them changed, or one dealt anew for more."""
    if len(chars) == j - i:
        tree.replace(i, chars, tokens)
        return tree
    chars, tokens = ([*old[:i], *new, *old[j:]] for old, new in ((tree.chars[0], chars), (tree.tokens[0], tokens)))
    some = [k for k, n in enumerate(chars) if n] or [0]
    return Tree([chars[k] for k in some], [tokens[k] for k in some])


def _counter(bpe, keep: int):
    bpe.keep = keep
    return lambda texts: [len(x) // 4 for x in bpe.encode_many(texts)]


def planted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, tree, n_tokens): every document with its tree, to be kept. Null text is empty (one
    empty leaf); repeated rows have a tree each. One narrow pass."""
    spec = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches):
        count = _counter(load(path, spec), CACHE_FRAGMENTS)
        for batch in batches:
            leaves = [leaves_of(t) for t in batch.column("text").to_pylist()]
            counts = count([x for xs in leaves for x in xs])
            trees, at = [], 0
            for xs in leaves:
                trees.append(Tree([*map(len, xs)], counts[at : at + len(xs)]))
                at += len(xs)
            columns = [batch.column("doc_id"), batch.column("text"), pa.array([t.kept() for t in trees], pa.binary()), pa.array([t.total for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "tree", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {kind}, text string, tree binary, n_tokens long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """`trees` with the rows (doc_id, seq, at, removed, added) of `edits` as an array in the order of seq. Edits of
    documents that are not there are left out; a null doc_id meets none. One document's edits follow one another and so
    come together in one row."""
    at = F.struct("seq", F.struct("at", "removed", "added").alias("e"))
    per = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["e"]).cast(f"array<{EDIT}>").alias("edits"))
    return trees.join(per, "doc_id", "left")


def edited(trees: DataFrame, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, tree, edits ARRAY<STRUCT<at, removed, added>>) -> (doc_id, text, tree, n_tokens, n_edits,
    reencoded_chars, leaves, *extra): text, tree and count after the edits. `extra` names columns to carry along.

    Edits apply in array order to the text as it is by then; positions are code points, beyond the end they mean the end,
    negative ones the start. Null edits are none, a null piece of an edit counts as 0 or empty. One narrow pass."""
    spec = broadcast_vocabulary(trees.sparkSession, path)
    names = ["text", "tree", "n_tokens", "n_edits", "reencoded_chars", "leaves"]
    own = ["doc_id", *extra]

    def run(batches):
        count = _counter(load(path, spec), KEEP)
        for batch in batches:
            texts, edits = batch.column("text").to_pylist(), batch.column("edits").to_pylist()
            trees, again = [*map(Tree.load, batch.column("tree").to_pylist())], [0] * len(texts)
            for nth in range(max((len(e or ()) for e in edits), default=0)):  # the nth edits of all documents together
                met = []
                for d, es in enumerate(edits):
                    if es and nth < len(es) and (e := es[nth]) is not None:
                        texts[d], i, j, leaves = touched(texts[d], trees[d], e["at"] or 0, e["removed"] or 0, e["added"] or "")
                        met.append((d, i, j, [*map(len, leaves)], leaves))
                counts = iter(count([x for m in met for x in m[4]]))
                for d, i, j, chars, leaves in met:
                    trees[d] = settled(trees[d], i, j, chars, [next(counts) for _ in leaves])
                    again[d] += sum(chars)
            out = [texts, [t.kept() for t in trees], [t.total for t in trees], [len(e or ()) for e in edits], again, [len(t.chars[0]) for t in trees]]
            kinds = [pa.string(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *(pa.array(x, t) for x, t in zip(out, kinds))], [*own, *names])

    schema = ", ".join(f"`{c}` {trees.schema[c].dataType.simpleString()}" for c in own)
    return trees.select(*own, "text", "tree", "edits").mapInArrow(run, f"{schema}, text string, tree binary, n_tokens long, n_edits long, reencoded_chars long, leaves long")


def kept(trees: DataFrame) -> DataFrame:
    """`trees` written to the shared folder and read back: what later batches of edits start from."""
    path = f"{shared_folder(trees.sparkSession)}/trees-{uuid.uuid4().hex}"
    trees.write.option("compression", "zstd").parquet(path)
    return trees.sparkSession.read.schema(trees.schema).parquet(path)


def _edit(at: Column, removed: Column, added: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), removed.cast("long").alias("removed"), added.alias("added"))


def first_edits() -> Column:
    """Three edits of a document from its own text: a swap inside, a deletion near the end, an insertion at the start."""
    n = F.length("text")
    third, most = F.floor(n / 3), F.floor(n * 9 / 10)
    return F.array(_edit(third, F.lit(7), F.substring("text", 1, 24)), _edit(most, F.lit(31), F.lit("")), _edit(F.lit(0), F.lit(0), F.concat(F.substring("text", 5, 9), F.lit("'s"))))


def later_edits() -> Column:
    """An edit of the document as the first batch left it: its middle goes, its end is put there."""
    half = F.floor(F.length("text") / 2)
    return F.array(_edit(half, F.lit(12), F.substring(F.col("text"), F.greatest(F.length("text") - 15, F.lit(1)), F.lit(16))))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count, after three edits, and after a further batch on the trees that these left."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    trees = kept(planted(table(spark, sf_dir, "documents"), path)).withColumnRenamed("n_tokens", "n_tokens_before")
    one = edited(trees.withColumn("edits", first_edits()), path, ("n_tokens_before",))
    one = one.withColumnsRenamed({"n_tokens": "n_tokens_after", "n_edits": "n_edits_first", "reencoded_chars": "reencoded_first"}).drop("leaves")
    two = edited(one.withColumn("edits", later_edits()), path, ("n_tokens_before", "n_tokens_after", "n_edits_first", "reencoded_first"))
    n_edits, again = F.col("n_edits") + F.col("n_edits_first"), F.col("reencoded_chars") + F.col("reencoded_first")
    return two.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_tokens_after", F.col("n_tokens").alias("n_tokens_later"), F.length("text").cast("long").alias("n_chars_later"), n_edits.alias("n_edits"), again.alias("reencoded_chars"), "leaves")
