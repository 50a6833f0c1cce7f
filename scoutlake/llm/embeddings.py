"""Near-duplicate embeddings (operator 3): Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and quantised; the WIDTH-wide cells of several projections
together name a bucket in each of several tables. What is shuffled to buckets is an entry of four numbers: bucket, vector
id and the signs of 128 further projections. Within a bucket, entries whose signs differ in more than SIGNS places can be no
near duplicates; the others fall into groups. Vectors whose signs hardly differ make clusters, over all tables. Only then do
vectors travel: once to their cluster, and to the groups of several clusters (in blocks, for large ones), to be compared by
matrix products in double precision. A pair of one cluster counts there; any other in the first table it shares, which both
vectors can tell from their own codes, so pairs never have to be gathered. Groups give each vector's number of links and
the links that keep them connected, not all pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, joined, table
from .components import components

COSINE = 0.95
WIDTH, SEED = 2.0, 20
#: The chance that two vectors at exactly COSINE share no bucket; it falls fast with the cosine.
MISS = 0.001
#: Unrelated vectors that a bucket holds by chance: more vectors take more projections to a table, and so more tables.
CHANCE = 64
#: Of 128 signs two vectors at COSINE differ in 13, unrelated ones in 64. More than 26 come up once in 10,000 pairs at COSINE.
SIGNS = 26
#: Two vectors whose signs differ in no more places belong to one cluster; unrelated ones never do.
CLOSE = 20
#: Vectors of a group that are compared in one matrix product; larger buckets are not searched by signs.
BLOCK = 1024
_TABLE_BITS = 10


def _cell_shared(distance: float) -> float:
    """The probability that two points at a Euclidean distance fall into one cell of a Gaussian projection."""
    t = WIDTH / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def plan(n: int) -> tuple[int, int]:
    """Projections to a table and tables for n different vectors. Unrelated vectors are taken to be at right angles."""
    near, far = _cell_shared(math.sqrt(2 - 2 * COSINE)), _cell_shared(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 1) / CHANCE) / -math.log(far)))
    return k, min((1 << _TABLE_BITS) - 1, math.ceil(math.log(MISS) / math.log(1 - near**k)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Finite vectors of one length, none zero, as unit vectors in double precision."""
    x = vectors.astype(float)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # else squares of tiny or huge components leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@functools.lru_cache(4)
def _directions(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(size, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.integers(1, 1 << 62, k) * 2 + 1, rng.normal(size=(size, 128))


def codes(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Each unit vector's bucket in every table, as one number each; its low bits are the table."""
    directions, shift, factors, _ = _directions(x.shape[1], k, tables)
    cells = np.floor((x @ directions + shift) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
    code = (cells * factors).sum(2) + factors[:1] * x.shape[1]  # wraps around; clashes only add comparisons
    return code >> _TABLE_BITS << _TABLE_BITS | np.arange(tables)


def signs(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    bits = x @ _directions(x.shape[1], k, tables)[3] >= 0
    return np.packbits(bits, axis=1).view(np.int64)


def _by_size(batch: pa.RecordBatch):
    """The batch's vectors of each length: (places in the batch, matrix)."""
    v = batch.column("v")
    ends, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, values[ends[at][:, None] + np.arange(size)]


def _entries(held: DataFrame, k: int, tables: int) -> DataFrame:
    """(rep, v) -> (bucket, rep, s1, s2), one row a table."""

    def run(batches):
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            for at, v in _by_size(batch):
                for s in range(0, len(at), 2048):
                    x, who = unit(v[s : s + 2048]), rep[at[s : s + 2048]]
                    columns = codes(x, k, tables).ravel(), *(np.repeat(c, tables) for c in (who, *signs(x, k, tables).T))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["bucket", "rep", "s1", "s2"])

    return held.select("rep", "v").mapInArrow(run, "bucket long, rep long, s1 long, s2 long")


def _least_linked(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least place that links p-q lead to."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[p], label[q])
        if (m == label[p]).all() and (m == label[q]).all():
            return label
        np.minimum.at(label, p, m)
        np.minimum.at(label, q, m)
        label = label[label]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ x.astype(np.uint64) >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _alike(bucket: np.ndarray, rep: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of whole buckets, in order -> (set, table, rep, close) of those that could be near another one of their
    bucket. Equal groups get the same set number in whatever table; `close` is the least id of a vector's close ones."""
    p, q, close, at = [], [], [], np.arange(len(bucket) - 1)
    for d in range(1, len(bucket)):
        at = at[: np.searchsorted(at, len(bucket) - d)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        apart = sum(np.bitwise_count((s[at] ^ s[at + d]).view(np.uint64)) for s in (s1, s2))
        near = apart <= SIGNS
        p.append(at[near])
        q.append(at[near] + d)
        close.append(apart[near] <= CLOSE)
    if not p:
        return (np.zeros(0, np.int64),) * 4
    p, q, close = np.concatenate(p), np.concatenate(q), np.concatenate(close)
    label = _least_linked(p, q, len(bucket))
    least = rep[_least_linked(p[close], q[close], len(bucket))]  # entries of a bucket come in the order of their ids
    some = np.unique(np.concatenate([p, q]))
    number = np.zeros(len(bucket), np.int64)
    np.add.at(number, label[some], _mixed(rep[some]))
    return number[label[some]], bucket[some] & ((1 << _TABLE_BITS) - 1), rep[some], least[some]


def _grouped(entries: DataFrame) -> DataFrame:
    """(bucket, rep, s1, s2) -> (set, table, block, rep, close): groups of possible near duplicates. Buckets of more than BLOCK
    entries pass whole, with their entries numbered off in blocks (-1: no blocks)."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4  # of the bucket that is not known to be whole
        large, count = None, 0

        def out(number, table, block, rep, close):
            return pa.RecordBatch.from_arrays([pa.array(number), pa.array(table.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(rep), pa.array(close)], ["set", "table", "block", "rep", "close"])

        def stretch(bucket, rep):
            nonlocal count
            block = (count + np.arange(len(bucket))) // BLOCK
            count += len(bucket)
            return out(bucket, bucket & ((1 << _TABLE_BITS) - 1), block, rep, rep)

        def whole(bucket, rep, s1, s2):
            """Of complete buckets: the small ones' groups, the large ones' entries."""
            nonlocal count
            _, first, n = np.unique(bucket, return_index=True, return_counts=True)
            big = np.repeat(n > BLOCK, n)
            for i, m in zip(first[n > BLOCK], n[n > BLOCK]):
                count = 0
                yield stretch(bucket[i : i + m], rep[i : i + m])
            number, table, who, close = _alike(*(c[~big] for c in (bucket, rep, s1, s2)))
            yield out(number, table, np.full(len(who), -1), who, close)

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("bucket", "rep", "s1", "s2")]
            if not len(new[0]):
                continue
            if large is not None:  # the bucket that goes on from earlier batches
                end = int(np.searchsorted(new[0], large, "right"))
                if end:
                    yield stretch(new[0][:end], new[1][:end])
                if end == len(new[0]):
                    continue
                large, new = None, [c[end:] for c in new]
            rows = [np.concatenate(c) for c in zip(held, new)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from whole(*(c[:last] for c in rows))
            held = [c[last:] for c in rows]
            if len(held[0]) > BLOCK:
                large, count = held[0][0], 0
                yield stretch(held[0], held[1])
                held = [np.zeros(0, np.int64)] * 4
        if len(held[0]):
            yield from whole(*held)

    return entries.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(run, "set long, table int, block int, rep long, close long")


def _compare(x: np.ndarray, code, t: int, i1: int, copies: np.ndarray, rep: np.ndarray, cluster: np.ndarray, out: list) -> None:
    """The rows of a group's one block with each other (i1 = all), or those of its first i1 rows with the others. A group of
    table t counts the pairs of different clusters that share no table before; a cluster (t = -1) counts all its pairs."""
    across = i1 < len(x)
    near = x[:i1] @ x[i1 if across else 0 :].T >= COSINE
    if not across:
        near &= ~np.tri(i1, dtype=bool)
    a, b = np.nonzero(near)
    if not len(a):
        return
    b = b + (i1 if across else 0)
    if t >= 0:
        other = cluster[a] != cluster[b]
        a, b = a[other], b[other]
        if not len(a):
            return
    c = code(x) if t > 0 else None
    for s in range(0, len(a), 1 << 18):
        p, q = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
        if t > 0:
            first = ~(c[p, :t] == c[q, :t]).any(1)
            p, q = p[first], q[first]
        links = np.bincount(p, copies[q], len(x)) + np.bincount(q, copies[p], len(x))
        order = np.argsort(rep)
        rank = np.argsort(order)
        least = rep[order][_least_linked(rank[p], rank[q], len(x))][rank]
        some = np.flatnonzero(links)
        out.append((rep[some], links[some].astype(np.int64), least[some]))


def _linked(shipped: DataFrame, k: int, tables: int) -> DataFrame:
    """(set, table, i, j, block, rep, cluster, copies, v) in groups of (set, table, i, j) -> (rep, links, least)."""

    def run(batches):
        code = lambda x: codes(x, k, tables)
        names = ("set", "table", "i", "j", "block", "rep", "cluster", "copies")
        key = names[:4]
        open_rows: list = []  # pieces (columns, vectors) of the group that may go on

        def close(out):
            rows = {n: np.concatenate([c[n] for c, _ in open_rows]) for n in names}
            x = unit(np.concatenate([v for _, v in open_rows]))
            open_rows.clear()
            order = np.argsort(rows["block"], kind="stable")
            within = rows["i"][0] == rows["j"][0]
            i1 = len(x) if within else int((rows["block"] == rows["i"][0]).sum())
            if within or 0 < i1 < len(x):
                _compare(x[order], code, int(rows["table"][0]), i1, rows["copies"][order].astype(float), rows["rep"][order], rows["cluster"][order], out)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy() for n in names}
            v = batch.column("v")
            ends, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.any([np.diff(columns[n]) != 0 for n in key], axis=0)) + 1
            out: list = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                piece = {n: c[a:b] for n, c in columns.items()}
                if open_rows and any(open_rows[0][0][n][0] != piece[n][0] for n in key):
                    close(out)
                open_rows.append((piece, values[ends[a] : ends[b]].reshape(b - a, -1)))
            yield _found(out)
        if open_rows:
            out = []
            close(out)
            yield _found(out)

    return shipped.mapInArrow(run, "rep long, links long, least long")


def _found(out: list) -> pa.RecordBatch:
    columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "least"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept).

    Equal vectors collapse into one row with a count before anything is compared. A bucket of more than BLOCK different
    vectors is dealt out as pairs of blocks. A vector without a direction (null, zero, null or non-finite components)
    links with nothing, not even its copies, and is its own component. Vectors of different lengths are never compared:
    the length is part of a bucket's number. Rows with a null id link with nothing and keep a null component. Repeated
    rows of one id count as copies of each other. Other columns are not read; an empty table gives an empty one."""
    kind = vectors.schema["embedding"].dataType.elementType
    v = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda e: e != 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    base = base.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    directed = base.filter("good")
    held = cut(directed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    k, tables = plan(total["n"])
    members = _grouped(_entries(held, k, tables)).groupBy("set", "rep").agg(F.min("table").alias("table"), F.max("block").alias("block"), F.min("close").alias("close"))
    members = cut(members)
    clusters = components(members.filter("close < rep").select(F.col("rep").alias("a"), F.col("close").alias("b")).distinct())
    members = members.join(clusters.withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    mixed = members.groupBy("set").agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b"), (F.max("block") + 1).alias("blocks")).filter("_a < _b").select("set", "blocks")
    groups = members.join(mixed, "set").select("set", "table", "blocks", "block", "rep", "cluster")
    sizes = clusters.groupBy(F.col("component").alias("set")).agg(F.count("*").alias("n"))
    own = clusters.select(F.col("component").alias("set"), F.col("node").alias("rep")).join(sizes, "set").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = own.select("set", F.lit(-1).alias("table"), "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "rep", F.col("set").alias("cluster"))
    # block i meets every block j >= i: its rows go to the groups (i, j) and (j, i) in order
    both = groups.unionByName(own).withColumn("block", F.greatest("block", F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    shipped = both.select("set", "table", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "cluster")
    shipped = shipped.join(held.select("rep", "copies", "v"), "rep").repartition("set", "i", "j").sortWithinPartitions("set", "table", "i", "j", "block", "rep")
    found = cut(_linked(shipped.select("set", "table", "i", "j", "block", "rep", "cluster", "copies", "v"), k, tables))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups_of = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    per_key = held.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(groups_of.withColumnRenamed("node", "rep"), "rep", "left")
    per_key = cut(per_key.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = joined(directed.select("vec_id", "k1", "k2"), per_key, ["k1", "k2"], F.col("copies") > total["rows"] // 1000).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
