"""Key columns on known spellings."""

from pyspark.sql import functions as F

from scoutlake.functions import keys as K


def values(spark, column, *inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_canonical_url(spark):
    papers = ["http://arxiv.org/abs/2408.00776", "https://arxiv.org/pdf/2408.00776v2", "https://www.arxiv.org/html/2408.00776v1/", "https://ar5iv.labs.arxiv.org/html/2408.00776"]
    assert set(values(spark, K.canonical_url, *papers)) == {"https://arxiv.org/abs/2408.00776"}
    a, b, c, d, e = values(spark, K.canonical_url, "http://somebody.github.io/", "https://somebody.github.io", "https://x.com/SomeBody", "https://example.test/Paper", "https://example.test/paper")
    assert a == b and c == "https://x.com/somebody" and d != e
    assert values(spark, K.canonical_url, "https://e.test/a?utm_source=x&id=7&b=1#top", "", None) == ["https://e.test/a?b=1&id=7", "", None]
    once = values(spark, K.canonical_url, *papers, "https://E.test/a//?z&y=1")
    assert values(spark, K.canonical_url, *once) == once


def parsed(spark, kind, *raws):
    return [(r["value"], r["artifact_url"], r["rejected"]) for r in values(spark, lambda x: K.parse_identity(F.lit(kind), x), *raws)]


def test_identities(spark):
    assert {p[0] for p in parsed(spark, "github", "Ada-Lovelace", "https://github.com/ada-lovelace/", "@ada-lovelace", "github.com/Ada-Lovelace/repo")} == {"ada-lovelace"}
    assert {p[0] for p in parsed(spark, "twitter", "@ada", "https://x.com/Ada", "https://twitter.com/ada")} == {"ada"}
    assert [p[2] for p in parsed(spark, "github", "https://github.com/orgs/x", "https", "a b", "https://notgithub.com/ada", None, " ")] == ["reserved", "reserved", "malformed", "wrong_host", "empty", "empty"]
    assert [p[2] for p in parsed(spark, "twitter", "https://twitter.com/i", "www", "https://paperindex.com/author/ada", "https://www.linkedin.com/in/ada")][:3] == ["reserved", "reserved", "wrong_host"]
    assert parsed(spark, "twitter", "https://x.com/Ada/status/12")[0] == (None, "https://x.com/ada/status/12", None)
    assert parsed(spark, "linkedin", "https://www.linkedin.com/posts/Ada-1", "/in/AdaLovelace", "https://de.linkedin.com/in/J%C3%BCrgen") == [(None, "https://linkedin.com/posts/ada-1", None), ("adalovelace", None, None), ("jürgen", None, None)]
    assert parsed(spark, "orcid", "https://orcid.org/0000-0002-1825-0097", "0000000218250097", "0000-0002-1825-0098", "7340-6671-6787-4375", "x") == [("0000-0002-1825-0097", None, None)] * 2 + [(None, None, "checksum"), (None, None, "not_assigned"), (None, None, "malformed")]


def test_names(spark):
    a, b, c, d, e, f = values(spark, K.compact_name, "Prof. Dr. Stefan Federkiel", "Stefan Federkiel", "Rebecca C. Reimann", "Rebecca Reimann", "Jürgen Groß", "Jurgen Gross")
    assert a == b and c == d and e == f
    assert values(spark, K.compact_name, "Jingming Wu", "Fen Wu", "", None, "Dr.") == ["jingming wu", "fen wu", "", "", ""]
    assert values(spark, K.is_person, "MakeItOut 2026", "Campus.ai", "some-own-lab", "Hack Robots", "None", "", None) == [False] * 7
    assert values(spark, K.is_person, "Fabian H. Sonn", "Carlos Ruiz-Gomera", "Stephan Rösner") == [True] * 3


def test_organisations(spark):
    assert set(values(spark, K.company_key, "Cumulus Rim GmbH", "Cumulus Rim, Inc.", "  CUMULUS   rim ")) == {"cumulus rim"}
    assert values(spark, K.company_key, "Café Ventures", "GmbH", " ", None) == ["cafe ventures", "gmbh", None, None]
    assert values(spark, K.institution_key, "Technische Universität München", "Technical University of Munich (TUM)", "The Technical University of Munich", " ") == ["technische universitat munchen", "technical university munich", "technical university munich", None]
    assert values(spark, K.domain_key, "https://www.Acme.example.", "acme.example/x", "", None) == ["acme.example", "acme.example", None, None]


def test_name_ratio(spark):
    df = spark.createDataFrame([("xinming tang", "pengliang dong"), ("w sung", "wenxiao sung"), ("ada", "ada"), ("", ""), ("a", "")], "a string, b string")
    assert [round(r[0], 1) for r in df.select(K.name_ratio(F.col("a"), F.col("b"))).collect()] == [53.8, 66.7, 100.0, 100.0, 0.0]


def test_places_keep_their_words(spark):
    assert values(spark, K.city_key, "São Paulo", "Frankfurt (Oder)", " -- ", None) == ["sao paulo", "frankfurt oder", None, None]
