"""Turns that repeat exactly."""

import hashlib
from itertools import permutations

from scoutlake.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_repeated_turns_stay_whole(spark):
    turns = [(1, 0, "user", "abcd")] * 2 + [(2, 0, "assistant", "abcde")] * 12 + [(3, 0, "tool", "世界"), (3, 0, "tool", "世界"), (3, 0, "assistant", "b")] + [(4, 0, None, "xyz"), (4, 0, "xyz", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(chat.as_events(df))).collect()}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (2, sha("user\nabcd\n" * 2))
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[2]["loss_sha256"]) == (12, 60, sha("abcde" * 12))
    for c in (3, 4):  # different turns of one number have no order of their own
        orders = permutations(f"{r or ''}\n{x or ''}\n" for k, _, r, x in turns if k == c)
        assert got[c]["turns_sha256"] in {sha("".join(o)) for o in orders}
    assert got[3]["loss_sha256"] == sha("b")


def test_the_log_of_turns_has_every_kind_of_event(spark):
    turns = [(1, 0, "user", "hello there"), (1, 1, "assistant", "an answer"), (1, 2, "user", None), (1, 3, "assistant", "x")]
    log = chat.as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {r["kind"] for r in log} == {"open", "edit", "regenerate", "delta"}
    for c, t, role, text in turns:
        own = sorted((r.asDict() for r in log if r["turn"] == t), key=lambda r: r["seq"])
        plain_text = ""
        for e in own:  # by the words of the contract, not by the operator's fold
            plain_text = plain_text + (e["text"] or "") if e["kind"] == "delta" else e["text"] or ""
        assert plain_text == (text or "") and chat.fold(own) == (role, text or "")
