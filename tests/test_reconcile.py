"""Merging under disagreements, against the loop that scores all pairs anew after every merge."""

import itertools
import random

import pytest

from scoutlake.operators import reconcile, resolve


def loop(people):
    """[(handles, pages)] in order -> merges in order, as the earliest pair that is one merges and all pairs are looked at again."""
    groups = {i: (set(h), set(p)) for i, (h, p) in enumerate(people)}
    out = []
    while True:
        for a, b in itertools.combinations(sorted(groups), 2):
            (ha, pa), (hb, pb) = groups[a], groups[b]
            by_handle = bool(ha & hb)
            if by_handle or (pa & pb and not {k for k, _ in ha} & {k for k, _ in hb}):
                out.append((a, b, by_handle))
                groups[a] = (ha | hb, pa | pb)
                del groups[b]
                break
        else:
            return out


def cluster(draw, n):
    kinds = ["github", "orcid", "twitter"]
    return [({(k, f"{k}{draw.randrange(max(2, n // 2))}") for k in kinds if draw.random() < 0.35}, {f"p{draw.randrange(max(1, n // 2))}" for _ in range(draw.randrange(3))}) for _ in range(n)]


def test_fold_is_the_loop():
    draw = random.Random(4)
    for n in (1, 2, 3, 4, 6, 9, 14):
        for _ in range(150):
            people = cluster(draw, n)
            assert list(reconcile.fold(people)) == loop(people), people


def test_a_page_of_many_people_who_disagree_takes_little_time():
    people = [({("github", f"g{i}")}, {"page"}) for i in range(20_000)] + [(set(), {"page"}) for _ in range(20_000)]
    assert len(list(reconcile.fold(people))) == 20_000


def frames(spark, clusters):
    people, handles, pages = [], [], []
    for c, members in enumerate(clusters):
        for i, (h, p) in enumerate(members):
            who = c * 100 + i
            people.append((who, f"Name{''.join(chr(97 + int(x)) for x in str(c))} Surname", None, None, None))
            handles += [(who, k, f"{c}-{v}") for k, v in h]
            pages += [(who, f"{c}-{u}") for u in p]
    handles += [(0, "github", "team"), (100, "github", "team"), (0, "github", None), (None, "github", "x")]
    return (
        spark.createDataFrame(people, "id long, display_name string, city string, company string, education array<string>"),
        spark.createDataFrame(handles, "id long, kind string, value string"),
        spark.createDataFrame([*pages, (0, None), (0, "all"), (100, "all")], "id long, url string"),
    )


def test_merges_over_many_clusters(spark):
    draw = random.Random(8)
    clusters = [cluster(draw, draw.randint(1, 9)) for _ in range(60)]
    want = {(c * 100 + b, c * 100 + a) for c, members in enumerate(clusters) for a, b, _ in loop(members)}
    rows = reconcile.merges(*frames(spark, clusters)).collect()
    assert {(r["id"], r["canonical"]) for r in rows if r["id"] != r["canonical"]} == want
    assert {r["id"] for r in rows if r["id"] == r["canonical"]} == {b for _, b in want}


def test_three_people_and_one_disagreement(spark):
    people, handles, pages = frames(spark, [[({("github", "a"), ("orcid", "1")}, set()), ({("github", "a")}, {"p"}), ({("orcid", "2")}, {"p"})]])
    merged, pairs = reconcile.reconciled(people, handles, pages)
    assert [(r["id"], r["canonical"], r["by"]) for r in merged.filter("id <> canonical").collect()] == [(1, 0, "handle")]
    assert [(r["left_id"], r["right_id"], r["decision"], r["conflicts"]) for r in pairs.collect()] == [(0, 2, "conflict", "orcid")]
    assert {r["metric"]: r["n"] for r in reconcile.report(merged, pairs, people).collect()} == {"merges": 1, "reviews": 0, "conflicts": 1, "location_updates": 3}
    dry, listed = reconcile.reconciled(people, handles, pages, dry_run=True)
    assert dry.count() == 0 and sorted(r["decision"] for r in listed.collect()) == ["conflict", "merge", "merge"]


def test_the_earliest_known_person_stays(spark):
    people, handles, pages = frames(spark, [[({("github", "a")}, set()), ({("github", "a")}, set()), ({("github", "a")}, set())]])
    known = spark.createDataFrame([(0, "2026-01-03"), (1, None), (2, "2026-01-01")], "id long, discovered_at string")
    rows = reconcile.merges(people.join(known, "id"), handles, pages).collect()
    assert {(r["id"], r["canonical"]) for r in rows} == {(0, 1), (1, 1), (2, 1)}


def test_nobody(spark):
    people, handles, pages = (x.limit(0) for x in frames(spark, [[(set(), set())]]))
    merged, pairs = reconcile.reconciled(people, handles, pages)
    assert merged.count() == 0 and pairs.count() == 0


def test_a_dry_run_merges_nothing_and_does_not_look_for_merges(spark, monkeypatch):
    people = spark.createDataFrame([(k, "Ada Lovelace", "Bonn", "c", []) for k in (1, 2, 3)], "id long, display_name string, city string, company string, education array<string>")
    handles = spark.createDataFrame([(1, "github", "a"), (2, "github", "a")], "id long, kind string, value string")
    monkeypatch.setattr(reconcile, "merges", lambda *_: 1 / 0)
    merged, pairs = reconcile.reconciled(people, handles, dry_run=True)
    assert merged.columns == ["id", "canonical", "step", "by"] and merged.isEmpty()
    assert {(r["left_id"], r["right_id"], r["decision"]) for r in pairs.collect()} == {(1, 2, "merge"), (1, 3, "review"), (2, 3, "review")}


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[k]))
    return 200 * row[-1] / (len(a) + len(b))


def swept(people):
    """{id: (name, city, {(kind, value)})} -> {(left, right, decision, confidence)}: the reference's sweep over all pairs."""
    owners = {}
    for name, _, handles in people.values():
        for h in handles:
            owners.setdefault(h, set()).add(name)
    out = set()
    for left, right in itertools.combinations(sorted(people), 2):
        (a, a_city, a_all), (b, b_city, b_all) = people[left], people[right]
        if a != b and not a_all & b_all:
            continue
        a_held, b_held = ({h for h in hs if len(owners[h]) == 1} for hs in (a_all, b_all))
        alike = ratio(a, b)
        apart = {k for k, _ in a_held} & {k for k, _ in b_held} if alike >= 96 and not a_held & b_held else set()
        if apart:
            out.add((left, right, "conflict", 0.0))
        elif a_held & b_held:
            out.add((left, right, "merge", 0.99))
        elif alike >= 96:
            out.add((left, right, "review", round(min(0.89, alike / 100 * 0.7 + 0.1 * (a_city == b_city)), 3)))
    return out


@pytest.mark.parametrize("few", [64, 1])
def test_near_names_that_share_a_handle_are_pairs_of_the_sweep(spark, monkeypatch, few):
    monkeypatch.setattr(resolve._near_of_one_handle, "__defaults__", (few,))
    draw = random.Random(few)
    names = ["annabelle lindstroemer", "annabelle lindstroeme", "annabella lindstroemer", "benedikt oppenheimer", "benedikt openheimer", "ada king"]
    people = {k: (draw.choice(names), draw.choice(["bonn", "ulm"]), {(kind, f"{kind}{draw.randrange(9)}") for kind in ("github", "orcid") if draw.random() < 0.6}) for k in range(40)}
    schema = "id long, display_name string, city string, company string, education array<string>"
    frame = spark.createDataFrame([(k, name, city, None, None) for k, (name, city, _) in people.items()], schema)
    handles = spark.createDataFrame([(k, *h) for k, (*_, held) in people.items() for h in held] + [(0, "github", None), (0, "website", "w"), (1, "website", "w")], "id long, kind string, value string")
    _, pairs = reconcile.reconciled(frame, handles, dry_run=True, strangers=True)
    want = swept(people)
    assert any(people[left][0] != people[right][0] for left, right, *_ in want)
    assert sorted(tuple(r)[:4] for r in pairs.collect()) == sorted(want)
