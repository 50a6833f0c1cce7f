"""Operator 11 against plain Python and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from scoutlake.llm import rules


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


ODD = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx", "#*$%&|<> ##", "\x0b\x0c\ré à b c \U0001f600 ok", "\n" * 1000, "ab c " * 3, "a bc " * 3,
       "one two three four one two three five two three four", "word " * 30_000, " ".join(map(str, range(20_000))) + " 1 2 3 4"]


def test_numbers_of_odd_texts(spark):
    draw = random.Random(5)
    texts = ODD + [" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 60))) + draw.choice(["", "\n", "\nab c\n"]) * 3 for _ in range(300)]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, host string")
    got = {r["doc_id"]: r for r in rules.judged(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), t
        failed = plain(t)[0] < 50 or 100 * plain(t)[4] > 50 * plain(t)[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)  # no host, no verdict


def good(i):
    return " ".join(f"w{i}x{k}" for k in range(60))


def hosts_table():
    rows = [(1000 * h + i, good(1000 * h + i) if i % 10 else "short", f"good{h}") for h in range(30) for i in range(40)]
    rows += [(50_000 + i, good(i) if i % 20 == 0 else "## spam", "https://WWW.Bad.example/a?b") for i in range(200)]
    rows += [(60_000 + i, "short" if i else good(i), "tiny.example") for i in range(3)]  # too few to tell
    rows += [(70_000, good(1), None), (70_001, good(2), ""), (None, good(3), "bad.example")]
    return rows


def test_hosts_are_judged_by_shrunk_rates(spark):
    df = spark.createDataFrame(hosts_table(), "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rules.judged(df).collect()}
    assert not any(got[50_000 + i]["kept"] for i in range(200)) and not got[50_000]["base_failed"]
    assert got[60_000]["kept"] and got[70_000]["kept"] and got[70_001]["kept"] and not got[None]["kept"]
    assert all(got[1000 * h + i]["kept"] == (i % 10 > 0) for h in range(30) for i in range(40))


def test_where_most_documents_of_all_hosts_fail_no_host_goes(spark):
    rows = [(100 * h + i, good(i) if i < 3 else "short", f"h{h}") for h in range(10) for i in range(50)]
    got = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["kept"] for r in got) == 30


def test_prior_by_hand(spark):
    hosts = [(10, 1), (20, 9), (30, 3), (5, 5)]
    df = spark.createDataFrame([(f"h{i}", n, k) for i, (n, k) in enumerate(hosts)], "host string, n long, short long")
    n, k = sum(x for x, _ in hosts), sum(y for _, y in hosts)
    between = sum(x * (y / x - k / n) ** 2 for x, y in hosts) / 3
    within = sum(y * (1 - y / x) for x, y in hosts) / (n - 4)
    size = (n - sum(x * x for x, _ in hosts) / n) / 3
    rho = (between - within) / (between + (size - 1) * within)
    mean, strength = rules.prior(df, "short")
    assert math.isclose(mean, k / n) and math.isclose(strength, max(rules.WEAKEST, 1 / rho - 1))
    row = rules.with_verdicts(df, {"short": (mean, strength)}).filter("host = 'h3'").first()
    assert math.isclose(row["short_rate"], (5 + mean * strength) / (5 + strength))


@pytest.mark.parametrize("rows", [[], hosts_table() + [(80_000 + i, t, "odd.example") for i, t in enumerate(ODD[:12])] + hosts_table()[:50]])
def test_sql_gives_the_same_rows(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = db.sql(rules.ORACLE)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, rules.judged(df).select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_host_of_a_source():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sources = {"src0": "src0", "https://www.A.org:80/x": "a.org", "http://u:p@b.de/": "b.de", "": None, None: None, "/only/a/path": None, "WWW.c.fr?x": "c.fr"}
    df = spark.createDataFrame([(s,) for s in sources], "source string")
    assert {r[0]: r[1] for r in df.select("source", rules.host(df["source"])).collect()} == sources
