"""Reconciling known people: merging to a fixpoint while disagreements hold people apart, then the pairs left for a human.

Two groups of people of one name are one if they share an identifying handle, whatever else they disagree on, or if they share
an artifact and have no kind of handle in common (handles of one kind that none shares speak against it). The earliest
pair that is one merges first, and what a group holds then is what all its members held: an artifact may join two people
that a third one's handle would have kept apart, and the other way round. So the outcome follows from the order, and
from each set of people linked by handles and artifacts alone. Sets in which no kind of handle has two values merge whole,
by joins; only in sets with two values of a kind, order can matter, and each of these is folded in one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from . import resolve as R
from .graph import groups, saved

Handle = tuple[str, str]


def fold(people: list[tuple[set[Handle], set[str]]]) -> Iterator[tuple[int, int, bool]]:
    """People of one name, in order, with their handles and artifacts -> (left, right, by handle), merges in order, by place.

    The first person takes in, again and again, the earliest one that is one with the group; when nobody is left, the next
    free person begins. Groups that are done stay apart: what one cannot take from two groups, it cannot take from both
    together. Candidates come from heaps: holders of a handle; for an artifact, holders by the kinds they have, of which
    those are passed over that have a kind in common with the group, so that a page of many people costs each of them little."""
    by_handle: dict[Handle, list[int]] = defaultdict(list)
    by_page: dict[str, dict[frozenset[str], list[int]]] = defaultdict(lambda: defaultdict(list))
    kinds = [frozenset(k for k, _ in handles) for handles, _ in people]
    for i, (handles, pages) in enumerate(people):
        for h in handles:
            by_handle[h].append(i)
        for p in pages:
            by_page[p][kinds[i]].append(i)
    free = [True] * len(people)
    for seed in range(len(people)):
        if not free[seed]:
            continue
        held: set[Handle] = set()
        met: set[str] = set()
        have: set[str] = set()
        heap: list[tuple[int, int, object]] = []  # person, next place in the bucket, bucket: (page, kinds), or None for a handle

        def take(i: int) -> None:
            free[i] = False
            handles, pages = people[i]
            have.update(kinds[i])
            for h in handles - held:
                held.add(h)
                for j in by_handle[h]:
                    heapq.heappush(heap, (j, -1, ()))
            for p in pages - met:
                met.add(p)
                for bucket, members in by_page[p].items():
                    heapq.heappush(heap, (members[0], 0, (p, *sorted(bucket))))

        take(seed)
        while heap:
            i, at, bucket = heapq.heappop(heap)
            if at >= 0:
                page, *apart = bucket
                if have.intersection(apart):
                    continue  # for good: the group's kinds only grow
                members = by_page[page][frozenset(apart)]
                while at < len(members) and not free[members[at]]:
                    at += 1
                if at == len(members):
                    continue
                if members[at] != i:
                    heapq.heappush(heap, (members[at], at, bucket))
                    continue
                heapq.heappush(heap, (i, at, bucket))
            if free[i]:
                yield seed, i, bool(people[i][0] & held)
                take(i)


def merges(people: DataFrame, handles: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, canonical, step, by) for everyone who is one with others: the id that stays (the earliest), when the person was
    merged into it within its linked set (0: it stays, null where order does not matter), by `handle` or `artifact`.

    people: id, display_name and, if given, discovered_at (null first), which order them; handles: id, kind, value;
    artifacts: id, url. Handles that people of different names claim join nobody and speak against nothing. Null handles,
    artifacts and names, and rows of unknown people, take no part."""
    order = [F.col("discovered_at").isNotNull(), F.col("discovered_at"), F.col("id")] if "discovered_at" in people.columns else [F.col("id")]
    named = saved(people.select("id", K.compact_name(F.col("display_name")).alias("name"), F.struct(*order).alias("at")).filter("name <> ''"))
    handles = handles.filter("value is not null").select("id", "kind", "value").distinct().join(named.select("id"), "id", "left_semi")
    good = saved(handles.join(R.shared_by_strangers(handles, named.select("id", "name")), ["kind", "value"], "left_anti"))
    pages = artifacts.filter("url is not null").select("id", "url").distinct().join(named, "id")
    several = pages.groupBy("name", "url").agg(F.min("id").alias("left"), F.max("id").alias("_most")).filter("left <> _most").drop("_most")
    pages = saved(pages.join(several, ["name", "url"]).select("id", "url", "left"))
    owners = good.groupBy("kind", "value").agg(F.min("id").alias("left"), F.max("id").alias("_most")).filter("left <> _most").drop("_most")
    links = pages.select("left", F.col("id").alias("right")).unionByName(good.join(owners, ["kind", "value"]).select("left", F.col("id").alias("right")))
    sets = saved(groups(links).select("id", F.col("canonical").alias("set")))
    own = saved(good.join(sets, "id"))
    disputed = saved(own.groupBy("set", "kind").agg(F.min("value").alias("_a"), F.max("value").alias("_b")).filter("_a <> _b").select("set").distinct())
    whole = sets.join(disputed, "set", "left_anti").join(named, "id")
    first = whole.groupBy("set").agg(F.min_by("id", "at").alias("canonical"))
    shares = good.join(owners, ["kind", "value"]).select("id").distinct().withColumn("_h", F.lit("handle"))
    plain = whole.join(first, "set").join(shares, "id", "left").select("id", "canonical", F.when(F.col("id") == F.col("canonical"), 0).cast("int").alias("step"), F.when(F.col("id") != F.col("canonical"), F.coalesce("_h", F.lit("artifact"))).alias("by"))
    none = F.lit(None).cast("string")
    facts = sets.select("id", "set", none.alias("kind"), none.alias("value")).unionByName(own.select("id", "set", "kind", "value")).unionByName(pages.join(sets, "id").select("id", "set", F.lit("").alias("kind"), F.col("url").alias("value")))
    rows = facts.join(disputed, "set").join(named.select("id", "at"), "id")
    return plain.unionByName(_folded(rows))


def _folded(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("set").sortWithinPartitions("set", "at", "id").select("set", "id", "kind", "value")

    def one(ids: list, facts: list[tuple[set[Handle], set[str]]]) -> Iterable[tuple]:
        canonical: dict[int, int] = {}
        for step, (left, right, by_handle) in enumerate(fold(facts), 1):
            if left not in canonical:
                canonical[left] = left
                yield ids[left], ids[left], 0, None
            canonical[right] = left
            yield ids[right], ids[left], step, "handle" if by_handle else "artifact"

    def run(batches):
        now, ids, facts, id_type = None, [], [], None

        def end() -> pa.RecordBatch:
            out = list(one(ids, facts))
            ids.clear()
            facts.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((id_type, id_type, pa.int32(), pa.string()))], ["id", "canonical", "step", "by"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for s, i, k, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and s != now:
                    yield end()
                now = s
                if not ids or ids[-1] != i:
                    ids.append(i)
                    facts.append((set(), set()))
                if k:
                    facts[-1][0].add((k, value))
                elif k is not None:
                    facts[-1][1].add(value)
        if ids:
            yield end()

    return dealt.mapInArrow(run, f"id {kind}, canonical {kind}, step int, by string")


def _listed(pairs: DataFrame) -> DataFrame:
    decision = F.when(F.size("conflicts") > 0, "conflict").when(F.col("score") >= R.MERGE_AT, "merge").when((F.col("score") >= R.REVIEW_AT) & F.col("named"), "review")
    pairs = pairs.withColumn("decision", decision).filter("decision is not null")
    return pairs.select(F.col("e_id").alias("left_id"), F.col("i_id").alias("right_id"), "decision", F.round("score", 3).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), F.array_join("conflicts", ",").alias("conflicts"))


def reconciled(people: DataFrame, handles: DataFrame, artifacts: DataFrame | None = None, dry_run: bool = False, strangers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merges, open pairs): who becomes whom as in `merges`, and (left_id, right_id, decision, confidence, reasons,
    conflicts) for pairs of the same name or with a shared identifying handle that are left for a human, `review` or `conflict`.
    With `strangers` also for near names that share a handle that identifies nobody, since strangers share it. Nobody is merged
    for that; such a pair that shares an artifact too is listed as `merge`.

    With `dry_run` nobody is merged: there are no merges, and pairs that would be one by themselves are listed as `merge`.
    Of a group, the one that stays keeps its name, city, company and education; handles and artifacts are those of all."""
    people, handles = saved(people.repartition("id")), saved(handles)  # each is read several times
    artifacts = handles.select("id", F.col("value").alias("url")).limit(0) if artifacts is None else saved(artifacts)
    if dry_run:
        merged = people.select("id", F.col("id").alias("canonical"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("by")).limit(0)
    else:
        merged = saved(merges(people, handles, artifacts))
    keep = saved(people.join(merged.filter("id <> canonical").select("id"), "id", "left_anti"))
    to = merged.select("id", "canonical")
    moved = lambda rows, *c: rows.join(to, "id", "left").select(F.coalesce("canonical", "id").alias("id"), *c).distinct()
    own, pages = saved(moved(handles, "kind", "value")), saved(moved(artifacts, "url"))
    pairs = R.scored(keep, keep, own, own, pages, pages, near=False, strangers=strangers).filter("i_id > e_id")
    if strangers:
        pairs = saved(pairs)  # the filter of `_listed` would compare near names anew for each of its terms
    return merged, _listed(pairs)


def report(merged: DataFrame, pairs: DataFrame, location_changes: DataFrame | None = None) -> DataFrame:
    """(metric, n): merges, reviews, conflicts and location updates of a run, dry or not, zeros too."""
    one = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    out = one("merges", merged.filter("id <> canonical").select("id").unionByName(pairs.filter("decision = 'merge'").select(F.col("right_id").alias("id"))))
    for name in ("review", "conflict"):
        out = out.unionByName(one(f"{name}s", pairs.filter(F.col("decision") == name)))
    return out if location_changes is None else out.unionByName(one("location_updates", location_changes))
