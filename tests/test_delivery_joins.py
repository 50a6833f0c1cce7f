"""Joins of a delivery whose sides grow with it: by sort and merge, nothing broadcast through the driver."""

from scoutlake.operators import intake


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_withheld_handles_are_found_and_taken_out_without_a_broadcast(spark):
    """A hundred mentions of one ORCID, which a known founder may hold already: only the holder keeps it."""
    own = spark.range(100).selectExpr("concat('f', id) as founder_id", "if(id >= 0, 'orcid', 'github') as kind", "concat('X', id % 1) as value", "id as mention_id")
    held = spark.range(1).selectExpr("'f7' as founder_id", "if(id >= 0, 'orcid', 'github') as kind", "concat('x', id) as value")
    for known, keeps in ((held, "f7"), (held.limit(0), "f0")):
        withheld = intake.claimed(own, known)
        left = own.join(withheld, ["founder_id", "kind"], "left_anti")
        assert [r["founder_id"] for r in left.collect()] == [keeps]
        assert "Broadcast" not in plan(left)


def test_known_reviews_are_left_out_without_a_broadcast(spark):
    people = spark.range(40).selectExpr("id", "concat('Ada Lovelace', id) as display_name", "'Bern' as city", "'X' as company", "array() as education")
    handles = spark.range(40).selectExpr("id", "'github' as kind", "concat('g', id) as value")
    placed = spark.range(40).selectExpr("id", "concat('f', id) as founder_id", "true as flagged", "'review' as method", "cast(null as string) as counterpart_id")
    first = intake.new_reviews(people, handles, placed, spark.range(0).selectExpr("cast(id as string) as fingerprint"))
    assert first.count() == 40
    prints = [r["fingerprint"] for r in first.orderBy("id").limit(15).collect()]
    known = spark.range(1).selectExpr("explode(array(" + ", ".join(f"'{p}'" for p in prints) + ")) as fingerprint")
    again = intake.new_reviews(people, handles, placed, known)
    assert {r["id"] for r in again.collect()} == set(range(15, 40))
    assert not any("Broadcast" in line and "LeftAnti" in line for line in plan(again).splitlines())


def test_a_second_delivery_reads_what_the_first_left_from_storage(spark, monkeypatch):
    """Not planned and made anew at every read: the frames that it gets from the first are saved ones."""
    from scoutlake.plans import intake as plans

    columns = {
        "founders": "cast(id as string) as founder_id, 'n' as display_name, 'c' as city, 'x' as company, 'o' as occupation, 0.5D as discovery_confidence, cast(array() as array<string>) as education",
        "handles": "cast(id as string) as founder_id, 'github' as kind, 'v' as value", "signals": "cast(id as string) as signal_id, 'u' as canonical_url, 'h' as content_hash",
        "edges": "cast(id as string) as founder_id, 's' as signal_id", "reviews": "cast(id as string) as fingerprint", "placements": "cast(id as string) as key, 'f' as founder_id",
    }
    monkeypatch.setattr(plans.N, "delivered", lambda *_: {k: spark.range(5).selectExpr(*c.split(", ")) for k, c in columns.items()})
    first, _ = plans._delivery(spark, "/root/testdata/sf0.001", again=True)
    assert all("Range (" not in plan(first[name]) and first[name].count() == 5 for name in columns)
