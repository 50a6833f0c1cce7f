"""SimHash near-duplicates (operator 6) by anchor-point covering.

Anchors are the words of a covering code over 61 of the 64 bits: two binary Golay codes (23 bits, covering radius 3) and a
Hamming code (15 bits, radius 1), all perfect, so every fingerprint has one nearest anchor within the radii. Two
fingerprints that differ in at most t bits have a point between them within ceil(t/2) bits of both, and that point's
anchor lies within the covering radius plus ceil(t/2) of each. So each fingerprint is copied to all anchors within the
radii plus ceil(t/2) (sixteen on average for t = 2), and only fingerprints at one anchor are compared. That finds every
pair within the threshold; copying as far as the radius plus t would only find them again.

Where many fingerprints crowd at one anchor they are not compared pair by pair: there the trivial covering code, in which
every point is an anchor of radius 0, takes over. Copies go to all points within one bit; fingerprints that meet differ by
at most two bits, so all of them link to the least one, in work proportional to their number.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import cut, joined, table, text_or_empty
from .components import components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: Fingerprints at one anchor that are still compared pair by pair.
CROWD = 32
#: Words of a text that are hashed at a time.
STEP = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text: A-Z in lower case, words between ASCII white space, shingles with repeats."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for begin in range(0, n, STEP):
        part = words[begin : min(n, begin + STEP) + shingle - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)))], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, *extra); the fingerprint as a signed 64-bit number. Null text is empty."""
    fields = [docs.schema["doc_id"], *(docs.schema[c] for c in extra)]

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(values)], [*(f.name for f in fields), "_fingerprint"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = docs.select(*(f.name for f in fields), F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, f"{columns}, _fingerprint long")
    return out.select("doc_id", F.col("_fingerprint").alias("fingerprint"), *extra)


def _remainders(words: np.ndarray, n: int, generator: int) -> np.ndarray:
    """Syndromes of a cyclic code: the n-bit words modulo the generator polynomial."""
    out, top = words.copy(), generator.bit_length() - 1
    for i in range(n - 1, top - 1, -1):
        out ^= np.where(out >> i & 1, generator << (i - top), 0)
    return out


class Block:
    """One perfect cyclic code on its own stretch of the bits."""

    def __init__(self, shift: int, n: int, generator: int, radius: int, beyond: int):
        self.shift, self.n, self.generator, self.radius = shift, n, generator, radius
        flips = [sum(1 << i for i in c) for w in range(radius + beyond + 1) for c in combinations(range(n), w)]
        flips = np.array(flips, np.int64)
        weight = np.array([int(x).bit_count() for x in flips])
        syndrome = _remainders(flips, n, generator)
        #: leader[s]: what to flip in a word of syndrome s to reach its nearest anchor
        self.leader = np.zeros(1 << (generator.bit_length() - 1), np.int64)
        near = weight <= radius
        self.leader[syndrome[near]] = flips[near]
        far, at = flips[~near], syndrome[~near]
        order = np.argsort(at, kind="stable")
        #: flips[first[s]:first[s + 1]]: the anchors up to `beyond` bits further away than the radius
        self.flips, self.first = far[order], np.searchsorted(at[order], np.arange(len(self.leader) + 1))

    def part(self, x: np.ndarray) -> np.ndarray:
        return x >> self.shift & ((1 << self.n) - 1)


@functools.cache
def blocks(beyond: int = 1) -> list[Block]:
    # The generator polynomials of the binary Golay code and of the Hamming code of 15 bits.
    return [Block(0, 23, 0b101011100011, 3, beyond), Block(23, 23, 0b101011100011, 3, beyond), Block(46, 15, 0b10011, 1, beyond)]


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint (int64) every anchor within the covering radii plus one: (index of the fingerprint, anchor)."""
    parts = [(b, p := b.part(x), _remainders(p, b.n, b.generator)) for b in blocks()]
    nearest = np.zeros(len(x), np.int64)
    for b, p, s in parts:
        nearest |= (p ^ b.leader[s]) << b.shift
    index, found = [np.arange(len(x))], [nearest]
    for b, p, s in parts:
        many = b.first[s + 1] - b.first[s]
        i = np.repeat(np.arange(len(x)), many)
        flip = b.flips[np.repeat(b.first[s], many) + np.arange(len(i)) - np.repeat(many.cumsum() - many, many)]
        index.append(i)
        found.append(nearest[i] ^ (b.leader[s][i] ^ flip) << b.shift)
    return np.concatenate(index), np.concatenate(found)


def _at_anchors(fingerprints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column("f").to_numpy()
            index, anchor = anchors(x)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(x[index])], ["anchor", "f"])

    return fingerprints.select("f").mapInArrow(run, "anchor long, f long")


def _around(f: Column) -> Column:
    """A fingerprint and the 64 that differ from it by one bit."""
    return F.array(f, *(f.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))


def links(distinct: DataFrame) -> DataFrame:
    """(f) distinct fingerprints -> (a, b): links within two bits that connect what all such pairs connect."""
    placed = cut(_at_anchors(distinct))
    crowds = placed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(placed.join(crowds, "anchor"))
    few = met.filter(F.col("n") <= CROWD)
    pairs = few.select("anchor", F.col("f").alias("a")).join(few.select("anchor", F.col("f").alias("b")), "anchor").filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
    crowded = met.filter(F.col("n") > CROWD).select("f").distinct().select("f", F.explode(_around(F.col("f"))).alias("point"))
    least = crowded.groupBy("point").agg(F.min("f").alias("b"), F.max("f").alias("_most")).filter("b < _most").drop("_most")
    stars = crowded.join(least, "point").select(F.col("f").alias("a"), "b")
    return pairs.select("a", "b").unionByName(stars).filter("a != b").distinct()


def near_duplicates(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id, *extra): fingerprint as 16 lower-case hex digits, component_id
    the smallest doc_id reachable over links of at most two differing bits.

    Documents of equal fingerprint (a third of all, perhaps) collapse into one row before anything is compared. Null
    text is empty and has fingerprint 0, null ids neither name a component nor are named by one of others; repeated
    rows stay as many. An empty table gives an empty one."""
    marked = cut(fingerprints(docs, extra=extra))
    distinct = cut(marked.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    groups = components(links(distinct))
    named = distinct.join(groups.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = cut(named.join(smallest, "component").select(F.col("f").alias("fingerprint"), "component_id", "copies"))
    return joined(marked, ids, ["fingerprint"], F.col("copies") > total // 1000).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", *extra)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents (all columns) without near duplicates: of each group the one with the smallest doc_id stays. Rows of
    one id are one document; rows without an id belong to no group and all stay. Texts are shuffled once, by id."""
    named = docs.filter("doc_id is not null")
    kept = near_duplicates(named.select("doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    return named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
