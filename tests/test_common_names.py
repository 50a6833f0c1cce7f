"""Mentions resolved by groups of people, against weighing every pair."""

import random

from test_jobs import handles, people

from scoutlake.operators import resolve
from scoutlake.operators.graph import saved


def case(spark, seed, n=70):
    draw = random.Random(seed)
    names = ["Ada Lovelace", "Grace Hopper", "Maximiliane Brandenburger", "Maximilane Brandenburger", ""]
    rows = [(k, draw.choice(names), draw.choice(["Bern", "Bonn", None]), draw.choice(["X", None])) for k in range(2 * n)]
    kinds = ("github", "orcid", "website")
    held = [(k, kind, f"{kind}{draw.randrange(40)}") for k, *_ in rows for kind in kinds if draw.random() < 0.3]
    pages = [(k, f"u{draw.randrange(25)}") for k, *_ in rows for _ in range(2) if draw.random() < 0.4]
    sides = [(lambda k: k < n), (lambda k: k >= n)]
    ps = [people(spark, *(r for r in rows if side(r[0]))) for side in sides]
    hs = [handles(spark, *(h for h in held if side(h[0]))) for side in sides]
    us = [spark.createDataFrame([u for u in pages if side(u[0])], "id int, url string").selectExpr("cast(id as bigint) as id", "url") for side in sides]
    holders = spark.createDataFrame([(k, n + draw.randrange(n)) for k in range(n)], "i_id long, e_id long")
    return ps, hs, us, holders


def test_groups_decide_as_all_pairs_do(spark):
    (asked, known), hs, us, holders = case(spark, 1)
    pairs = saved(resolve.scored(asked, known, *hs, *us))
    for who in (None, holders):
        got = resolve.resolved(asked, known, *hs, *us, who).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, resolve.decided(asked, pairs, who).collect()))
        assert {r["method"] for r in got} == {"exact_key", "artifact", "review", "conflict", "new"}


def test_a_common_name_with_pages_makes_no_square_of_pairs(spark, monkeypatch):
    """Everyone has a page and a handle of their own; the contexts are two."""
    met, scores = [], resolve._scores
    monkeypatch.setattr(resolve, "_scores", lambda pairs, *rest: (met.append(pairs.count()), scores(pairs, *rest))[1])
    n = 300
    asked, known = (people(spark, *((k, "Ada Lovelace", "Bern" if k % 2 else "Bonn", None) for k in range(at, at + n))) for at in (0, n))
    hs = [spark.range(at, at + n).selectExpr("id", "'github' as kind", "concat('h', id % 290) as value") for at in (0, n)]
    us = [spark.range(at, at + n).selectExpr("id", "concat('u', id) as url") for at in (0, n)]
    out = resolve.resolved(asked, known, *hs, *us)
    assert out.count() == n and sum(met) < 3 * n
