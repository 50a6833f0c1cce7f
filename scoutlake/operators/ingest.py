"""Signal ingestion: payloads to hits, canonical keys, idempotent upserts, attribution edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import saved


def signal_keys(rows: DataFrame, url: str = "url", title: str = "title", summary: str = "summary") -> DataFrame:
    """Adds canonical_url, content_hash, source and source_reliability to landed artifacts."""
    out = rows.withColumn("canonical_url", K.canonical_url(F.col(url))).withColumn("content_hash", K.content_hash(F.col(title), F.col(summary)))
    out = out.withColumn("source", K.source_of(F.col("canonical_url")))
    entries = F.create_map(*(F.lit(x) for kv in K.RELIABILITY.items() for x in kv))
    return out.withColumn("source_reliability", F.coalesce(F.element_at(entries, F.col("source")), F.lit(0.4)))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order. An aggregate, not a window: a hot key is reduced within every task."""
    rest = [c for c in rows.columns if c not in key]
    at = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), at).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def upsert_new(batch: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The batch's rows that the target lacks, one per key; appending them twice changes nothing."""
    return first_of_each(batch, key, order).join(target.select(*key), key, "left_anti")


def capped_hits(hits: DataFrame, most: int = 300, longest: int = 1500) -> DataFrame:
    """(query_no, pos, subgoal, url, title, content) -> the first hit of each canonical URL in the order of queries, `most` of
    a run at most and `longest` characters of content each: the features that bound what is read further."""
    keyed = hits.withColumn("canonical_url", K.canonical_url(F.col("url"))).filter("coalesce(canonical_url, '') <> ''")
    once = first_of_each(keyed, ["canonical_url"], ["query_no", "pos"])
    return once.withColumn("content", F.substring(F.coalesce("content", F.lit("")), 1, longest)).orderBy("query_no", "pos").limit(most)


def capped_per_group(rows: DataFrame, group: str, key: str, order: list[str], most: int) -> DataFrame:
    """The first hit of each key, then at most `most` of each group: the feature that bounds research hits per goal."""
    once = first_of_each(rows, [key], order)
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return once.withColumn("rank", n).filter(F.col("rank") <= most)


def _created(rows: DataFrame) -> DataFrame:
    """(canonical_url, content_hash, at) -> those that make a signal when taken in the order `at`: a row makes one unless an
    earlier row that made one has its URL or its content.

    In rounds: a row that comes first both of its URL and of its content makes a signal, which settles all others of
    either. Every round settles the first row of every group that is linked by URLs and contents, so the number of rounds
    follows the longest chain of such links, not the number of rows."""
    made, left = None, saved(rows)
    while True:
        of_url = left.groupBy("canonical_url").agg(F.min("at").alias("_u"))
        of_content = left.filter("content_hash is not null").groupBy("content_hash").agg(F.min("at").alias("_h"))
        first = left.join(of_url, "canonical_url").join(of_content, "content_hash", "left").filter((F.col("at") == F.col("_u")) & (F.col("_h").isNull() | (F.col("at") == F.col("_h"))))
        now = saved(first.select("canonical_url", "content_hash", "at"))
        made = now if made is None else made.unionByName(now)
        left = saved(left.join(now.select("canonical_url"), "canonical_url", "left_anti").join(now.select("content_hash"), "content_hash", "left_anti"))
        if left.isEmpty():
            return made


def materialised(payloads: DataFrame, signals: DataFrame, order: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """Each payload's signal, as taking payloads one after another in `order` finds it: by canonical URL, stored or made by an
    earlier payload, else by content hash, stored or made likewise, else it is made here. A market signal that a founder
    payload meets is promoted.

    Adds signal_id (null for a signal of this batch), signal_url (the signal's canonical URL), matched_by (`url`, `hash`, `new`,
    or `batch_url` and `batch_hash` for one that an earlier payload made) and promoted. Payloads of null content are met by
    URL only; several stored signals of one URL or content count as the least; ties of the order go by URL, then content."""
    by_url = signals.filter("canonical_url is not null").groupBy("canonical_url").agg(F.min("signal_id").alias("_by_url"))
    by_hash = signals.filter("content_hash is not null").groupBy("content_hash").agg(F.min("signal_id").alias("_by_hash"))
    stored = signals.groupBy("signal_id").agg(F.any_value("kind").alias("_kind"), F.any_value("canonical_url").alias("_url"))
    out = payloads.withColumn("at", F.struct(*order, "canonical_url", "content_hash")).join(by_url, "canonical_url", "left").join(by_hash, "content_hash", "left")
    out = saved(out)
    fresh = out.filter("_by_url is null and _by_hash is null").groupBy("canonical_url", "content_hash").agg(F.min("at").alias("at"))
    made = saved(_created(fresh))
    url = made.select("canonical_url", F.col("at").alias("_u"))
    content = made.filter("content_hash is not null").select("content_hash", F.col("at").alias("_h"), F.col("canonical_url").alias("_made"))
    out = out.join(url, "canonical_url", "left").join(content, "content_hash", "left")
    before = lambda c: F.coalesce(F.col(c) <= F.col("at"), F.lit(False))
    matched = F.when(F.col("_by_url").isNotNull(), "url").when(F.col("_u") == F.col("at"), "new").when(before("_u"), "batch_url").when(F.col("_by_hash").isNotNull(), "hash").when(before("_h"), "batch_hash")
    out = out.withColumn("matched_by", matched)
    out = out.withColumn("signal_id", F.when(F.col("matched_by") == "url", F.col("_by_url")).when(F.col("matched_by") == "hash", F.col("_by_hash"))).join(stored, "signal_id", "left")
    out = out.withColumn("signal_url", F.when(F.col("signal_id").isNotNull(), F.col("_url")).when(F.col("matched_by") == "batch_hash", F.col("_made")).otherwise(F.col("canonical_url")))
    return out.withColumn("promoted", F.coalesce(F.col("_kind") == "market", F.lit(False))).drop("_by_url", "_by_hash", "_kind", "_url", "_u", "_h", "_made", "at")


def attributed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Attribution edges after a delivery: confidence only rises, and the method is the winner's; the first time stays."""
    both = existing.select("founder_id", "signal_id", "confidence", "method", "attributed_at", F.lit(0).alias("_new")).unionByName(incoming.select("founder_id", "signal_id", "confidence", "method", "attributed_at", F.lit(1).alias("_new")))
    best = F.struct(F.col("confidence").isNotNull(), F.col("confidence"), -F.col("_new"), F.col("method"))
    return both.groupBy("founder_id", "signal_id").agg(F.max("confidence").alias("confidence"), F.max_by("method", best).alias("method"), F.min("attributed_at").alias("attributed_at"))


def merged_urls(signals: DataFrame, *edges: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """Signals (signal_id, source, canonical_url, ingested_at) that became one under new keys: (survivors with `n`, how many each
    stands for; mapping signal_id, survivor, n, at; then each of `edges`, given as a frame and its key, re-keyed).

    The earliest ingested signal of (source, canonical_url) survives. A mapping table, joined once to every child, takes the
    place of row updates."""
    at = F.struct("ingested_at", "signal_id")
    groups = signals.groupBy("source", "canonical_url").agg(F.min_by("signal_id", at).alias("survivor"), F.count("*").alias("n"))
    mapping = signals.join(groups, ["source", "canonical_url"]).select("signal_id", "survivor", "n", at.alias("at"))
    survivors = signals.join(mapping.filter("signal_id = survivor").select("signal_id", "n"), "signal_id")
    return survivors, mapping, *(moved_edges(e, mapping, key) for e, key in edges)


def moved_edges(edges: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Edges (key, signal_id, ...) on the survivors. Where a key has several by then, the survivor's own stays, else that of the
    earliest signal that was merged: one edge whole, so a stance or method never goes with another edge's weight. Edges of
    signals that the mapping lacks are dropped; repeated edges of one signal count by their values, least first."""
    rest = [c for c in edges.columns if c not in (key, "signal_id")]
    rows = edges.join(mapping.select("signal_id", "survivor", F.col("at").alias("_at")), "signal_id").drop("signal_id")
    return first_of_each(rows.withColumnRenamed("survivor", "signal_id"), [key, "signal_id"], ["_at", *rest]).select(*edges.columns)


def rekeyed(signals: DataFrame, new_url: Column) -> DataFrame:
    """Signals under new canonical URLs; an external id that was the old URL follows it."""
    follows = F.col("external_id").eqNullSafe(F.col("canonical_url"))
    return signals.withColumn("external_id", F.when(follows, new_url).otherwise(F.col("external_id"))).withColumn("canonical_url", new_url)


def keywords(text: Column, stop: list[str], most: int) -> Column:
    """The first `most` different words of a query that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9+#.\-]*[a-z0-9+#]|[a-z0-9]"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(stop))), 1, most)


def split_artifacts(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long profile references (founder_id, kind, raw) -> (identities, artifacts as profile_activity signals)."""
    parsed = profiles.withColumn("p", K.parse_identity(F.col("kind"), F.col("raw")))
    identities = parsed.select("founder_id", "kind", "raw", "p.value", "p.rejected")
    artifacts = parsed.filter("p.artifact_url is not null").select("founder_id", F.col("p.artifact_url").alias("canonical_url"), F.lit("profile_activity").alias("signal_type"), F.lit(0.55).alias("source_reliability")).distinct()
    return identities, artifacts
