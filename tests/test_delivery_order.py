"""Artifacts of one delivery and placements, against taking rows one after another."""

import random

from pyspark.sql import functions as F

from scoutlake.operators import ingest, resolve


def one_by_one(payloads, signals):
    urls, hashes, out = {}, {}, {}
    for sid, url, content, _ in sorted(signals):
        urls.setdefault(url, (sid, url)) if url else None
        hashes.setdefault(content, (sid, url)) if content else None
    stored = {sid for sid, *_ in signals}
    for key, url, content in sorted(payloads, key=lambda p: (p[0], p[1], p[2] or "")):
        met = urls.get(url) or (hashes.get(content) if content else None)
        if met is None:
            met = urls[url] = (None, url)
            if content:
                hashes[content] = met
            how = "new"
        else:
            how = ("" if met[0] in stored else "batch_") + ("url" if url in urls else "hash")
        out[key, url, content] = (*met, how)
    return out


def test_artifacts_as_if_taken_in_order(spark):
    for seed in range(6):
        draw = random.Random(seed)
        n = 60 if seed else 0
        payloads = list({(i, f"u{draw.randrange(25)}", draw.choice([None] + [f"c{k}" for k in range(25)])) for i in range(n)})
        if seed == 5:  # a long chain of links by URL and content in turn
            payloads = [(i, f"u{i // 2}", f"c{(i + 1) // 2}") for i in range(40)]
        signals = [(i, f"u{draw.randrange(60)}", f"c{draw.randrange(60)}", draw.choice(["market", "founder"])) for i in range(8)] + [(90, None, "c3", "market"), (91, "u4", None, "founder")]
        df = spark.createDataFrame(payloads, "id int, canonical_url string, content_hash string")
        stored = spark.createDataFrame(signals, "signal_id int, canonical_url string, content_hash string, kind string")
        got = {(r["id"], r["canonical_url"], r["content_hash"]): (r["signal_id"], r["signal_url"], r["matched_by"]) for r in ingest.materialised(df, stored, ("id",)).collect()}
        assert got == one_by_one(payloads, signals)


def test_a_tie_stays_with_the_holder_and_better_evidence_moves_nothing(spark):
    pairs = spark.createDataFrame(
        [(1, 10, 0.97, ["artifact"], []), (1, 11, 0.97, ["artifact"], []), (2, 10, 0.99, ["github"], []), (2, 11, 0.97, ["artifact"], []), (3, 10, 0.97, ["artifact"], []), (3, 11, 0.8, ["name"], []), (4, 10, 0.97, ["artifact"], []), (4, 11, 0.0, ["name"], ["orcid"])],
        "i_id int, e_id int, score double, reasons array<string>, conflicts array<string>",
    ).withColumn("named", F.lit(True))
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    holders = spark.createDataFrame([(i, 11) for i in (1, 2, 3, 4)], "i_id int, e_id int")
    who = lambda rows: {r["id"]: r["matched_id"] for r in rows.collect()}
    assert who(resolve.decided(asked, pairs)) == {1: 10, 2: 10, 3: 10, 4: 10}
    assert who(resolve.decided(asked, pairs, holders)) == {1: 11, 2: 11, 3: 10, 4: 10}  # only evidence that still makes them one holds


def test_keys_of_mentions(spark):
    rows = [(1, "Ada Lovelace", "Bern", "X", ["ETH"]), (2, "ada  lovelace", "bern", "x", ["ETH"]), (3, "Ada Lovelace", "Bern", "X", None), (4, "Ada Lovelace", "Bern", "X", ["ETH"])]
    people = spark.createDataFrame(rows, "id int, display_name string, city string, company string, education array<string>")
    handles = spark.createDataFrame([(1, "github", "a"), (1, "orcid", "o"), (2, "orcid", "o"), (2, "github", "a"), (2, "github", "a"), (3, "github", "a"), (3, "orcid", "o"), (4, "github", "b")], "id int, kind string, value string")
    pages = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, "u")], "id int, url string")
    key = {r["id"]: r["key"] for r in resolve.mention_keys(people, handles, pages).collect()}
    assert key[1] == key[2] and len(set(key.values())) == 3
