"""Operator 12 against plain Python: every string of edits for short conversations, a plain table of best strings for longer
ones, and the damage and the counts row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from scoutlake.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")
ROLE = {"u": "user", "a": "assistant"}


def next_role(roles):
    return "a" if roles and roles[-1] == "u" else "u"


def apply(audit, rows):
    """The repaired rows and the cost of an audit, or None if it is not allowed."""
    out, cost, rows = [], 0, iter(rows)
    for letter in audit:
        if letter == "I":
            role = next_role("".join(r[:1] for r, _ in out))
            out.append((ROLE[role], ""))
            cost += 5
            continue
        role, text, fault = next(rows)
        if letter == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += 5 * (fault == "truncated") + (letter == "R")
        out.append((role if letter == "K" else ROLE[next_role("".join(r[:1] for r, _ in out))], text))
    return (out, cost) if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in out)) else None


def by_all_strings(rows, most_inserts=3):
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        gaps = len(rows) + 1
        for k in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(gaps), k):
                audit = "".join("I" * places.count(i) + (letters[i] if i < len(rows) else "") for i in range(gaps))
                got = apply(audit, rows)
                if got and (best is None or (got[1], audit) < best):
                    best = (got[1], audit)
    return best


def by_table(rows):
    """Best (cost, audit) for each state of the pattern, row after row, with insertions anywhere."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def close(at):
        for _ in range(4):
            for state, (cost, audit) in list(at.items()):
                role = "a" if state == "u" else "u"
                new = step[state, role]
                at[new] = min(at.get(new, (9e9, "")), (cost + 5, audit + "I"))
        return at

    at = {"": (0, "")}
    for role, _, fault in rows:
        new = {}
        for state, (cost, audit) in close(at).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, role[:1]) in step:
                    options.append((step[state, role[:1]], more, "K"))
                options.append((step[state, "a" if state == "u" else "u"], 1 + more, "R"))
            for to, extra, letter in options:
                new[to] = min(new.get(to, (9e9, "")), (cost + extra, audit + letter))
        at = new
    at = close(at)
    return min(at[s] for s in ("", "a") if s in at)


def expected(turns):
    """The query's row of each conversation, from (conv_id, turn, role, text)."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in (t for t in turns if t[0] == conv):
            show = lambda x: " " if x is None else str(x)
            role, text = show(role), show(text)
            k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            words = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "ok"
            seen.add((role, text))
            faulty.append((role, text, fault))
        known = {t for t, _, _ in rows if t is not None}
        count = lambda f, rows=faulty: sum(x[2] == f for x in rows)
        cost, audit = by_table(faulty)
        fixed, again = apply(audit, faulty)
        assert again == cost
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(faulty))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def test_the_table_agrees_with_all_strings():
    draw = random.Random(1)
    for _ in range(120):
        rows = [(draw.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", draw.choice(["ok", "ok", "blank", "duplicate", "truncated"])) for i in range(draw.randint(0, 4))]
        assert by_table(rows) == by_all_strings(rows), rows


@pytest.mark.parametrize("rounds", [0, 6])
def test_matrices_of_rules_agree_with_the_table(rounds):
    draw = random.Random(rounds)
    roles = ["system", "user", "user", "assistant", "assistant", "tool"]
    faults = ["ok"] * 5 + ["blank", "duplicate", "truncated", "truncated"]
    kinds = {"ok": repair.OK, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}
    for n in (0, 1, 2, 5, 9, 40, 300):
        for _ in range(30):
            rows = [(draw.choice(roles), "", draw.choice(faults)) for _ in range(n)]
            symbols = "".join(repair.symbol(r[:1], kinds[f]) for r, _, f in rows)
            rules = []
            for _ in range(rounds):  # rules of rules, from the string itself
                s = repair.Grammar(rules).compressed(symbols)
                rules += [s[i : i + 2] for i in range(0, min(len(s) - 1, 3))][:1]
            solver = repair.Solver(repair.Grammar(rules))
            cut = draw.randint(0, n)
            solver.add(symbols[:cut])
            solver.add(symbols[cut:])
            assert solver.end() == by_table(rows)


def run(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = repair.repaired(repair.damaged(df)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_whole_jobs_with_odd_rows(spark):
    draw = random.Random(7)
    texts = ["Yes.", "No", "", None, "  \n", "Why?", "a" * 200_000 + ".", "ok.", "x", "été!", "\U0001f600.", "tail.  "]
    turns = []
    for conv in [*range(150), None]:
        for turn in range(draw.randint(1, 9)):
            turns.append((conv, draw.choice([turn, turn, turn, None, turn // 2, turn * 3]), draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), draw.choice(texts)))
    turns += turns[:40]  # repeated rows
    assert run(spark, turns) == expected(turns)


def test_a_conversation_of_most_rows(spark, monkeypatch):
    """Long conversations are cut into pieces and over tasks; one row a thousand times."""
    monkeypatch.setattr(repair, "PIECE", 50)
    draw = random.Random(3)
    turns = [(1, t, draw.choice(["user", "assistant"]), draw.choice([f"t{t}.", f"t{t}", "same."])) for t in range(1500)]
    turns += [(1, 700, "user", "again and again.")] * 1000 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    assert run(spark, turns) == expected(turns)


def test_repaired_turns_follow_the_audit(spark):
    turns = [(c, t, r, f"{c} {t}.") for c in range(30) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", "user"])]
    rows = repair.damaged(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    said = repair.repaired_turns(rows, repair.decided_by(rows)).collect()
    want = expected(turns)
    for conv in range(30):
        mine = sorted((r["position"], r["role"], r["text"]) for r in said if r["conv_id"] == conv)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in mine).encode()).hexdigest() == want[conv][7]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, head string, fault int, c string")
    assert repair.repaired(repair.damaged(empty)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "Hi.", "h", 3, "c")], empty.schema)
    assert [r["audit"] for r in repair.repaired(repair.damaged(extra)).collect()] == [expected([(1, 0, "user", "Hi.")])[1][6]]
