"""People whose names differ by a letter or a few."""

import random

from scoutlake.operators import resolve
from test_jobs import resolution


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_near_names_against_all_pairs(spark):
    rng = random.Random(5)

    def changed(name, n):
        for _ in range(n):
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "a", "b"]) + name[at + rng.randrange(2) :]
        return name

    names = ["".join(rng.choice("ab cd") for _ in range(n)) for n in (3, 11, 12, 13, 18, 24, 25, 26, 37, 38, 50, 63, 90)]
    left = sorted({changed(x, rng.randrange(4)) for x in names for _ in range(8)} | set(names))
    right = sorted({changed(x, rng.randrange(4)) for x in names for _ in range(8)} | set(names))
    got = resolve.near_names(*(spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right))).collect()
    want = {(a, b) for a in left for b in right if a != b and ratio(a, b) >= 96}
    assert len(got) == len(want) > 50 and set(map(tuple, got)) == want


def crowd(n, seed=9):
    """Names of which a third share a first name, each with a near one on the other side."""
    rng = random.Random(seed)
    names = [("maximiliane" if k % 3 == 0 else "".join(rng.choice("abcdefghijklmnop") for _ in range(11))) + "".join(rng.choice("abcdefghijklmnop") for _ in range(15)) for k in range(n)]
    near = []
    for x in names:
        at, to = sorted(rng.sample(range(len(x)), 2))
        near.append(rng.choice([x[:at] + x[at + 1 : to] + x[to + 1 :], x[:at] + "z" + x[at:], x[:at] + "q" + x[at + 1 :], x[:at] + "yy" + x[at:]]))
    return names, near


def test_a_common_first_name_makes_no_square_of_pairs(spark):
    def sides(n):
        names, near = crowd(n)
        return names, near, [spark.createDataFrame([(x, len(x)) for x in s], "name string, n int") for s in (near, names)]

    met = {}
    for n in (400, 1600):
        names, near, frames = sides(n)
        met[n] = resolve.shared_parts(*frames, hot_above=20).count()
    assert met[1600] < 6 * met[400] and met[1600] < 40 * 1600
    found = set(map(tuple, resolve.near_names(*(f.select("name") for f in frames)).collect()))
    want = {(a, b) for a, b in zip(near, names, strict=True) if a != b and ratio(a, b) >= 96}
    assert len(want) > 1000 and want <= found


def test_hot_parts_lose_no_pair(spark):
    names, near = crowd(120)
    frames = [spark.createDataFrame([(x, len(x)) for x in s], "name string, n int") for s in (near, names)]
    want = {(a, b) for a in near for b in names if len(a) + len(b) >= 50 and ratio(a, b) >= 96}
    for above in (0, 3, 10**6):
        assert want <= set(map(tuple, resolve.shared_parts(*frames, hot_above=above).collect()))


def test_a_letter_more_is_the_same_name(spark):
    mention, known = "Maximiliane Brandenburger", "Maximilane Brandenburger"
    r = resolution(spark, (1, mention, None, None), [(10, known, None, None), (11, "Ada Lovelace", None, None)], [], [])
    assert (r["decision"], r["matched_id"], r["method"]) == ("review", 10, "review")
    r = resolution(spark, (1, mention, "Bern", "Engine"), [(10, known, "bern", "ENGINE")], [], [])
    assert (r["decision"], r["confidence"]) == ("review", 0.89)
    r = resolution(spark, (1, mention, None, None), [(10, known, None, None)], [(1, "github", "max1")], [(10, "github", "max2")])
    assert (r["decision"], r["method"]) == ("review", "conflict")
