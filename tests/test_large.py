"""People of any number: no join of a resolution sends a side of them through the driver."""

from scoutlake.operators import resolve as R
from scoutlake.operators.graph import saved


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_saved_rows_are_joined_where_they_are(spark):
    rows = saved(spark.range(9).selectExpr("id", "md5(cast(id as string)) as name"))
    assert "Broadcast" not in plan(rows.join(rows.filter("id > 3").groupBy("name").count(), "name"))


def test_no_side_of_a_resolution_is_broadcast(spark):
    people = "id long, display_name string, city string, company string, education array<string>"
    known = spark.createDataFrame([(k, f"Anna Maria Lindström{'abcdefgh'[k]}", "Bonn", "c", []) for k in range(8)], people)
    met = spark.createDataFrame([(10 + k, f"Anna Maria Lindström{'abcdefgh'[k]}", "Bonn", "d", []) for k in range(3)], people)
    handles = spark.createDataFrame([(1, "github", "a"), (2, "github", "b")], "id long, kind string, value string")
    own = spark.createDataFrame([(11, "github", "a")], "id long, kind string, value string")
    pages = spark.createDataFrame([(1, "u"), (12, "u")], "id long, url string")
    out = R.resolved(met, known, own, handles, pages, pages)
    assert "Broadcast" not in plan(out)
    assert {(r["id"], r["decision"], r["matched_id"]) for r in out.collect()} == {(10, "review", 0), (11, "merge", 1), (12, "review", 2)}
