"""Source divergence audit (operator 13): how far the sources of a language differ in the words they use.

Texts are read as Arrow buffers, a slice of documents at a time. Pointers to the starts of words are sorted by what they point
at, a multikey quicksort over eight bytes at a time: one sort orders all pointers by their first eight bytes, and
only runs of equal ones whose words go on are sorted by the next eight. Documents of one source stand together and sorts are
stable, so each run of equal words falls into stretches of one source, and their lengths and documents are the counts.
Counts are then summed by (language, word, source), words of too few documents go, and shares are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

#: A kept word occurs in at least so many documents of its language; so many words are reported for each source.
LEAST_DOCUMENTS, TOP = 10, 10
#: Bytes of text sorted at once; a longer text is a slice of its own.
SLICE = 16 << 20
#: Sources compared in one block, and words in one step of a block.
SOURCES, STEP = 64, 2048
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[np.r_[0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The first 0 to 8 bytes of a big-endian number.
_FIRST = np.array([((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(9)], np.uint64)


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start in a buffer of texts, their lengths in bytes, and the text each lies in; none spans two texts."""
    inside = _TERM[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    # a slice is far below 2 GB unless one text is not
    small = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.flatnonzero(start).astype(small)
    return at, (np.flatnonzero(end) + 1).astype(small) - at, (np.searchsorted(offsets, at, "right") - 1).astype(small)


def sorted_pointers(low: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the pointers' order by their words' bytes, equal ones as they came, and where a new word begins.

    `low` ends with eight bytes that are in no word. Keys are eight bytes of a word; zeros, which no word has, fill it up."""
    eight = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))

    def keys(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(length[which] - 8 * depth, 0, 8)
        return eight[np.minimum(at[which].astype(np.int64) + 8 * depth, len(eight) - 1)].astype(np.uint64) & _FIRST[left]

    first = keys(np.arange(len(at)), 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    head = np.ones(len(at), bool)
    head[1:] = first[1:] != first[:-1]
    open_, key, depth = np.arange(len(at)), first, 0
    while True:
        # slices to sort on: more than one pointer, and words that may go on after these eight bytes
        run = np.cumsum(head[open_]) if len(open_) else open_
        several = np.bincount(run, minlength=1)[run] > 1 if len(open_) else np.zeros(0, bool)
        keep = several & (key & np.uint64(0xFF) != 0)
        open_, run = open_[keep], run[keep]
        if not len(open_):
            return order, head
        depth += 1
        key = keys(order[open_], depth)
        by = np.lexsort((key, run))
        order[open_], key = order[open_][by], key[by]
        head[open_[1:]] |= (run[1:] == run[:-1]) & (key[1:] != key[:-1])


def slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, groups, occurrences, documents): for each word and group of texts that has it. `group` numbers the texts'
    groups in ascending order."""
    validity, starts, data = texts.buffers()
    offsets = np.frombuffer(starts, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    at, length, text = word_pointers(data, offsets)
    if not len(at):
        return [], *(np.zeros(0, np.int64) for _ in range(3))
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    order, head = sorted_pointers(low, at, length)
    text = text[order]
    of = group[text]
    stretch = head.copy()
    stretch[1:] |= of[1:] != of[:-1]
    document = stretch.copy()
    document[1:] |= text[1:] != text[:-1]
    begins = np.flatnonzero(stretch)
    occurrences = np.diff(np.append(begins, len(order)))
    documents = np.add.reduceat(document.astype(np.int64), begins)
    view, p, n = low.tobytes(), at[order][head].tolist(), length[order][head].tolist()
    words = [view[a : a + b] for a, b in zip(p, n, strict=True)]
    number = np.cumsum(head)[begins] - 1
    return [words[k] for k in number.tolist()], of[begins], occurrences, documents


def word_counts(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """(text, lang, source) -> (lang, term, source, count, documents), several rows for a word that is in several slices."""

    def counts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        names = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows["lang"], rows["source"])], ["lang", "source"])
        found: dict[tuple, int] = {}
        group = np.array([found.setdefault((x["lang"], x["source"]), len(found)) for x in names.to_pylist()], np.int64)
        by = np.argsort(group, kind="stable")
        texts = pa.chunked_array([rows["text"].combine_chunks()] if isinstance(rows["text"], pa.ChunkedArray) else [rows["text"]]).cast(pa.large_string()).combine_chunks()
        texts = texts.take(pa.array(by))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        words, of, occurrences, documents = slice_counts(texts, group[by])
        langs, sources = (pa.array([g[k] for g in found] or [""], pa.string()).take(pa.array(of)) for k in (0, 1))
        term = pa.array(words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs, term, sources, pa.array(occurrences), pa.array(documents)], ["lang", "term", "source", "count", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= slice_bytes:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, source string, count long, documents long")


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, count, lang_count) of the words kept, with the counts of the source and of the language.

    Rows are dealt by (language, word) once; sums by source and over sources follow in place. A common word has one row a
    slice and source, no more than any word that every slice has."""
    counts = word_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    of = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_documents": F.sum("documents").over(of), "lang_count": F.sum("count").over(of)})
    return counts.filter(F.col("lang_documents") >= least_documents).select("lang", "term", "source", "count", "lang_count")


def _share(count: str, total: str, words: str):
    """p: parts of a milliard, exactly."""
    big = lambda x: f"cast({x} as decimal(19, 0))"
    return F.expr(f"1 + ({big(SCALE)} * {big(f'{count} + 2')}) div {big(f'{total} + 2 * {words}')}")


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over rows (words) of floor((p-q)^2/(p+q)) for each column of p against each of q."""
    out = np.zeros((p.shape[1], q.shape[1]), np.int64)
    for a in range(p.shape[1]):
        d = p[:, a : a + 1] - q
        out[a] = (d * d // (p[:, a : a + 1] + q)).sum(axis=0)
    return out


def pair_sums(groups: DataFrame, kept: DataFrame, sources: int = SOURCES) -> DataFrame:
    """(lang, a, b, value) with a < b, numbers of sources: sums over all kept words of the language, those that neither has
    too. groups: (lang, source, number, v, p0), v the language's words and p0 a word's share that does not occur; kept: (lang,
    term, number, p).

    A block holds some sources against some others and a share of the words; a row of a source goes to all blocks of the
    source's row and column (one, where there are no more sources than a block takes), and a block's sources lead it. A block
    never meets words that only sources of other blocks have: all words count as missing once, in the first share, and
    those that are met count as what they are instead."""
    parts = shuffle_partitions(groups.sparkSession)
    most = groups.groupBy("lang").agg((F.max("number") / sources).cast("int").alias("blocks"))
    own = (F.col("number") / sources).cast("int")

    def blocked(rows: DataFrame) -> DataFrame:
        rows = rows.join(most, "lang").withColumn("_own", own)  # one row a language
        other = F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("_other")
        rows = rows.select("*", other).drop("blocks")
        return rows.withColumns({"x": F.least("_own", "_other"), "y": F.greatest("_own", "_other")}).drop("_own", "_other")

    words = blocked(kept.select("lang", "term", "number", "p", F.lit(None).cast("long").alias("v"))).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    heads = blocked(groups.select("lang", F.lit(None).cast("string").alias("term"), "number", F.col("p0").alias("p"), "v")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["lang", "x", "y", "part"]
    columns = [*key, "term", "number", "p", "v"]
    rows = words.select(columns).unionByName(heads.select(columns)).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        heads: list[tuple[int, int]] = []
        rows: dict[str, list[tuple[int, int]]] = {}
        total, at, base, missing, all_words = None, {}, None, None, 0

        def sides() -> tuple[np.ndarray, np.ndarray]:
            of = np.array([n // sources for n in at])
            return np.flatnonzero(of == block[1]), np.flatnonzero(of == block[2])

        def begin() -> None:
            nonlocal total, at, base, missing
            heads.sort()
            at = {number: k for k, (number, _) in enumerate(heads)}
            base = np.array([p for _, p in heads], np.int64)
            total = np.zeros((len(heads), len(heads)), np.int64)
            i, j = sides()
            if all_words:
                missing = _divergences(base[None, i], base[None, j])
                if block[3] == 0:
                    total[np.ix_(i, j)] += all_words * missing

        def add() -> None:
            if total is None:
                begin()
            if rows:
                p = np.repeat(base[None, :], len(rows), axis=0)
                for k, found in enumerate(rows.values()):
                    for number, share in found:
                        p[k, at[number]] = share
                i, j = sides()
                total[np.ix_(i, j)] += _divergences(p[:, i], p[:, j]) - len(rows) * missing
                rows.clear()

        def end() -> pa.RecordBatch:
            add()
            numbers = [n for n, _ in heads]
            out = [(block[0], a, b, int(total[at[a], at[b]])) for a in numbers for b in numbers if a < b and a // sources == block[1] and b // sources == block[2]]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "a", "b", "value"])

        for batch in batches:
            for *now, term, number, p, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(now) != block:
                    if block is not None:
                        yield end()
                    block, total = tuple(now), None
                    heads.clear()
                if term is None:
                    heads.append((number, p))
                    all_words = v
                    continue
                if term not in rows and len(rows) >= STEP:
                    add()
                rows.setdefault(term, []).append((number, p))
        if block is not None:
            yield end()

    return rows.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(text, lang, source) -> (lang, source, part, item, value, rank). Part `pair`: a source against every other one of its
    language; part `term`: the words that a source has above its language's share, the `top` first.

    Nulls are empty strings; a language or source of that name is one like any other, also without words. Repeated rows are
    documents of their own; ties come by the item's bytes. Other columns are not read; an empty table gives an empty one.
    There are as many pairs as the answer has rows; nothing else grows with the square of anything."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = cut(kept_counts(docs, least_documents))
    # a row a source: what it holds, and V and the count of its language
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    words = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    totals = sums.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(totals, "lang", "left").join(words, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = cut(groups.withColumn("number", number.cast("int")).withColumn("p0", F.when(F.col("v") > 0, _share("0", "n", "v")).otherwise(0)))
    rows = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("count", "n", "v"), "q": _share("lang_count", "lang_n", "v")})
    item = lambda part, name, value: ("lang", "source", F.lit(part).alias("part"), name.alias("item"), value.alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    term = rows.filter("count > 0 and p > q").select(*item("term", F.col("term"), F.expr("((p - q) * (p - q)) div (p + q)")))
    term = term.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)  # each task keeps its first ones only
    sums = cut(pair_sums(groups, rows))
    both = sums.select("lang", "a", "b", "value").unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda n, as_: groups.select("lang", F.col("number").alias(n), F.col("source").alias(as_))
    pair = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "other"), ["lang", "b"]).select(*item("pair", F.col("other"), F.col("value")))
    return pair.withColumn("rank", F.row_number().over(best)).unionByName(term)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


ORACLE = rf"""with d as (select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as lang_count from t group by lang, term having count(distinct rid) >= {LEAST_DOCUMENTS}),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v, sum(lang_count) as lang_n from k group by lang),
g as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (cast({SCALE} as hugeint) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) as p,
  1 + (cast({SCALE} as hugeint) * (k.lang_count + 2)) // (v.lang_n + 2 * v.v) as q
  from g join k on g.lang = k.lang join v on g.lang = v.lang left join c on g.lang = c.lang and g.source = c.source and k.term = c.term),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source as s, y.source as o, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
  on f.lang = a.lang and f.s = a.source and f.o = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
where part = 'pair' or rank <= {TOP}"""
