"""Document fingerprints (operator 1): threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a bound, a fixed fraction of the hash range, so that sketches of unions follow from
sketches and containment can be estimated between documents of very unequal length. The bound is kept with the hashes: a
document of at most WHOLE different shingles keeps them all (fraction 1), longer ones the lowest quarter of the range.
Two sketches are compared below the smaller of their bounds, where both are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

SHINGLE = 5
#: The fraction of all shingle hashes that long documents keep, and the bound on signed 64-bit hashes that it means.
FRACTION = 1 / 4
BOUND = int((2 * FRACTION - 1) * (1 << 63))
#: Documents of up to so many different shingles keep all: the bound is the range's end.
WHOLE = 256
EVERY = (1 << 63) - 1
#: Blocks of neighbouring documents for each shuffle partition.
BLOCKS = 6


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, bound: int = BOUND, whole: int = WHOLE) -> DataFrame:
    """`df` with the sketch of column `text` as `name`, STRUCT<bound, hashes> with the hashes in order: words between white
    space in lower case, shingles of five (shorter texts whole). Null or blank text has no hashes.

    Each step is a column of its own that the next one reads several times, so that it is computed once a row and not
    again within each step of a higher-order function."""
    words, hashes = f"_{name}_words", f"_{name}_hashes"
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))  # each word is hashed once; a shingle hashes its words' hashes
    w = F.col(words)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle))))
    df = df.withColumn(hashes, F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(shingles))).drop(words)
    return _keep(df, hashes, F.lit(EVERY), name, bound, whole).drop(hashes)


def _keep(df: DataFrame, hashes: str, complete_to: Column, name: str, bound: int, whole: int) -> DataFrame:
    """The sketch of different `hashes` that are complete below `complete_to`."""
    to = F.when(F.size(hashes) > whole, F.least(complete_to, F.lit(bound))).otherwise(complete_to)
    df = df.withColumn(f"_{name}_bound", to)
    kept = F.array_sort(_below(F.col(hashes), F.col(f"_{name}_bound")))
    return df.withColumn(name, F.struct(F.col(f"_{name}_bound").alias("bound"), kept.alias("hashes"))).drop(f"_{name}_bound")


def _below(hashes: Column, bound: Column) -> Column:
    return F.when(bound == EVERY, hashes).otherwise(F.filter(hashes, lambda h: h < bound))


def merged(df: DataFrame, a: str, b: str, name: str, bound: int = BOUND, whole: int = WHOLE) -> DataFrame:
    """`df` with the sketch of both documents' shingles together as `name`, the same as if it were made from them."""
    to = F.least(f"{a}.bound", f"{b}.bound")
    df = df.withColumn(f"_{name}_union", F.array_union(_below(F.col(f"{a}.hashes"), to), _below(F.col(f"{b}.hashes"), to)))
    return _keep(df, f"_{name}_union", to, name, bound, whole).drop(f"_{name}_union")


def compared_by(df: DataFrame, a: str, b: str, like: str, inside: str | None = None) -> DataFrame:
    """`df` with the estimated share of common shingles among all of two documents (Jaccard) as `like`, 0 to 1, and that of
    a's shingles that b has, however much longer b is, as `inside`.

    Two sketches without hashes are alike, and an empty text is contained in any. Where texts have hashes but none below
    the common bound, nothing can be said of containment: null; likeness is then 0."""
    to = F.least(f"{a}.bound", f"{b}.bound")
    for side in (a, b):
        df = df.withColumn(f"_{side}_low", _below(F.col(f"{side}.hashes"), to))
    low_a, low_b = F.col(f"_{a}_low"), F.col(f"_{b}_low")
    df = df.withColumn("_both", F.size(F.array_intersect(low_a, low_b)))
    either = F.size(low_a) + F.size(low_b) - F.col("_both")  # hashes of a sketch differ
    none = F.size(f"{a}.hashes") + F.size(f"{b}.hashes") == 0
    df = df.withColumn(like, F.when(none, 1.0).when(either == 0, 0.0).otherwise(F.col("_both") / either).cast("double"))
    if inside is not None:
        df = df.withColumn(inside, F.when(F.size(f"{a}.hashes") == 0, 1.0).when(F.size(low_a) > 0, F.col("_both") / F.size(low_a)).cast("double"))
    return df.drop(f"_{a}_low", f"_{b}_low", "_both")


def digits(sketch: Column) -> Column:
    """A sketch as text: its bound and its hashes in hex, in order; an empty text has none."""
    hexed = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(F.size(sketch["hashes"]) == 0, "").otherwise(F.concat(hexed(sketch["bound"]), F.array_join(F.transform(sketch["hashes"], hexed), "")))


def _blocks(docs: DataFrame, key: str, tie: str) -> Column:
    """A block number for each row, in the order of (key, tie), with about as many rows in each.

    Edges are the key's approximate quantiles. A key that takes several edges (many rows of one key) is cut by its tie, a
    64-bit hash, into as many blocks; so are rows without a key, which come first."""
    spark = docs.sparkSession
    wanted = BLOCKS * shuffle_partitions(spark)
    edges = sorted(docs.approxQuantile(key, [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)))  # as many as blocks
    share = lambda n: F.least(F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * n), n - 1).cast("int")
    if not edges:
        return share(F.lit(wanted))
    # numbers beyond 2^53 round as the quantiles did: neighbours still share a block or an edge
    at = F.col(key).cast("double")
    bounds = F.lit(edges).cast("array<double>")
    below, equal = F.size(F.filter(bounds, lambda e: e < at)), F.size(F.filter(bounds, lambda e: e == at))
    within = F.when(equal > 1, share(equal) + 1).otherwise(equal)
    return F.when(F.col(key).isNull(), share(F.lit(wanted)) - wanted).otherwise(below + within)


def with_next(docs: DataFrame, key: str, tie: str, text: str, then) -> DataFrame:
    """`then(rows)` for rows dealt into blocks of neighbours, each with the columns that `then` adds of the row after it in
    the order of (key, tie, text), after the last those of the first, as the struct next.

    Within a block the next row is a window's lead, and a block's last row takes the first row of the block that follows,
    one row a block. No order over all rows in one place, and only the columns of `docs` are shuffled."""
    order = [key, tie, text]
    rows = docs.withColumn("_block", _blocks(docs, key, tie))
    first = rows.groupBy("_block").agg(F.min_by(F.struct(text), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))).alias("_first"))
    turn = Window.orderBy("_block")  # one row a block
    after = F.coalesce(F.lead("_first").over(turn), F.first("_first").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = then(first.select("_block", after.alias("_after")).select("_block", f"_after.{text}"))
    carried = [c for c in heads.columns if c != "_block"]
    heads = heads.select("_block", F.struct(*carried).alias("_after"))
    within = Window.partitionBy("_block").orderBy(*(F.asc_nulls_first(c) for c in order))
    led = then(rows.repartition("_block")).withColumn("_next", F.lead(F.struct(*carried)).over(within))
    out = led.join(heads, "_block")  # few rows on the right
    return out.withColumn("next", F.coalesce("_next", "_after")).drop("_block", "_next", "_after")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_in_edited): each text's sketch against that of its edited text, whose last quarter is the next document's
    beginning, and of the next document.

    Null text is empty. Rows of equal or null id follow each other by a hash of their text, then by text; null ids come
    first; other columns are not read. One row has itself as the next one. An empty table gives an empty one."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", "_tie", "text", lambda df: with_sketch(df, "text", "sketch"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", 1, n - quarter), F.substring("next.text", 1, quarter)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("after"), F.sha2("_edited", 256).alias("edited_sha256"), "_edited")
    rows = with_sketch(rows, "_edited", "edited").drop("_edited")
    rows = compared_by(compared_by(rows, "sketch", "edited", "near_edited", "contained_in_edited"), "sketch", "after", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", digits(F.col("sketch")).alias("fingerprint"), digits(F.col("edited")).alias("edited_fingerprint"), "near_edited", "near_next", "contained_in_edited")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
