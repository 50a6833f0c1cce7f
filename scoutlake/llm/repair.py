"""Conversation structure repair (operator 12): the cheapest edits that bring a conversation's roles to `(s?(ua)+)?`.

Rows become symbols (initial of the role, first fault). Re-Pair finds pairs of symbols that are frequent over all
conversations and makes rules of them. Each rule has one min-plus matrix over the four states of the pattern: the least
cost from state to state, how the ways from a state to the others are ordered, and by which state the way goes in
the middle, a rope of edits that is only written out for the ways taken. A rule's matrix follows from those of its two
parts, and serves every conversation that holds the rule.

Ties take the least audit. Every row's edits, insertions before it and then its own letter, form a prefix-free code, so two
different audits of the same rows always differ within both: which is less is known when ways meet, is never changed by
what follows, and ranks of the four states are all that is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

INITIALS = "sua"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits; an insertion's text is empty, a truncated row that stays costs more.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: States of the pattern: nothing yet, after s, after u, after a. The role that leads on, and whether one may end there.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rounds of rule making and rules a round: together the bound on the grammar, which is all that goes through the driver.
ROUNDS, RULES_A_ROUND = 8, 32
#: Symbols a piece holds at most.
PIECE = 4096
#: Rules are written as characters from here on (private use).
_RULE = 0xE000


def symbol(initial: str, fault: int) -> str:
    return chr(ord("A") + 4 * (INITIALS.find(initial) if initial and initial in INITIALS else 3) + fault)


def meaning(x: str) -> tuple[str, int]:
    k = ord(x) - ord("A")
    return "sua?"[k // 4], k % 4


class Matrix:
    """cost[i][j], rank[i][j] (order of the ways from i by audit) and way[i][j] (a terminal's audit, or a rule's state in the
    middle); None where no way leads. first, last: initials of the outer rows; counts: illegal, blank, duplicate, truncated."""

    __slots__ = ("cost", "rank", "way", "first", "last", "counts", "parts")

    def __init__(self, first, last, counts, parts):
        self.cost, self.rank, self.way = ([[None] * 4 for _ in STATES] for _ in range(3))
        self.first, self.last, self.counts, self.parts = first, last, counts, parts


def _inserted(i: int) -> Iterator[tuple[int, str]]:
    """States that insertions reach from i, with their letters, one way to each."""
    seen, state, letters = {i}, i, ""
    yield i, ""
    while (state := STEP[state, NEXT_ROLE[state][0]]) not in seen:
        seen.add(state)
        letters += "I"
        yield state, letters


def terminal(x: str) -> Matrix:
    initial, fault = meaning(x)
    m = Matrix(initial, initial, (0, fault == BLANK, fault == DUPLICATE, fault == TRUNCATED), None)
    stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
    for i in STATES:
        ways: dict[int, tuple[int, str]] = {}
        for mid, letters in _inserted(i):
            own = [(mid, DELETE, "D")]
            if fault in (OK, TRUNCATED):
                own += [(STEP[mid, initial], stays, "K")] if (mid, initial) in STEP else []
                own.append((STEP[mid, NEXT_ROLE[mid][0]], stays + REROLE, "R"))
            for j, cost, letter in own:
                way = INSERT * len(letters) + cost, letters + letter
                ways[j] = min(ways.get(j, way), way)
        order = sorted(ways, key=lambda j: ways[j][1])
        for j, (cost, audit) in ways.items():
            m.cost[i][j], m.way[i][j], m.rank[i][j] = cost, audit, order.index(j)
    return m


def product(a: Matrix, b: Matrix) -> Matrix:
    counts = tuple(x + y for x, y in zip(a.counts, b.counts, strict=True))
    m = Matrix(a.first, b.last, (counts[0] + ((a.last, b.first) not in LEGAL), *counts[1:]), (a, b))
    for i in STATES:
        ways = {}
        for j in STATES:
            meet = [(a.cost[i][k] + b.cost[k][j], a.rank[i][k], k) for k in STATES if a.cost[i][k] is not None and b.cost[k][j] is not None]
            if meet:
                ways[j] = min(meet)
        order = sorted(ways, key=lambda j: (ways[j][1], b.rank[ways[j][2]][j]))
        for j, (cost, _, k) in ways.items():
            m.cost[i][j], m.way[i][j], m.rank[i][j] = cost, k, order.index(j)
    return m


def audit_of(m: Matrix, i: int, j: int) -> str:
    """The rope from i to j written out, without recursion."""
    out, todo = [], [(m, i, j)]
    while todo:
        m, i, j = todo.pop()
        if m.parts is None:
            out.append(m.way[i][j])
        else:
            k = m.way[i][j]
            todo += [(m.parts[1], k, j), (m.parts[0], i, k)]
    return "".join(out)


class Grammar:
    """Rules, each a pair of earlier symbols, and a matrix for every symbol, made bottom-up."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {x: terminal(x) for x in map(chr, range(ord("A"), ord("A") + 16))}
        for k, (a, b) in enumerate(rules):
            self.matrices[chr(_RULE + k)] = product(self.matrices[a], self.matrices[b])

    def compressed(self, symbols: str) -> str:
        for k, pair in enumerate(self.rules):
            if pair in symbols:
                symbols = symbols.replace(pair, chr(_RULE + k))
        return symbols


class Solver:
    """A conversation's least cost so far at every state, with ranks by audit and ropes; grows symbol by symbol."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.texts = grammar, {}
        self.at = {0: (0, 0, None)}  # state -> cost, rank, rope: (rope before, symbol, from, to)
        self.last, self.counts = None, (0, 0, 0, 0)

    def add(self, symbols: str) -> None:
        for x in self.grammar.compressed(symbols):
            m = self.grammar.matrices[x]
            met = 0 if self.last is None else (self.last, m.first) not in LEGAL
            self.counts = (self.counts[0] + m.counts[0] + met, *(a + b for a, b in zip(self.counts[1:], m.counts[1:], strict=True)))
            self.last = m.last
            ways = {}
            for j in STATES:
                meet = [(cost + m.cost[i][j], rank, i) for i, (cost, rank, _) in self.at.items() if m.cost[i][j] is not None]
                if meet:
                    ways[j] = min(meet)
            order = {j: r for r, j in enumerate(sorted(ways, key=lambda j: (ways[j][1], m.rank[ways[j][2]][j])))}
            self.at = {j: (cost, order[j], (self.at[i][2], x, i, j)) for j, (cost, _, i) in ways.items()}

    def end(self) -> tuple[int, str]:
        """(cost, audit): insertions may still close the pattern."""
        ends = []
        for i, (cost, rank, rope) in self.at.items():
            for j, letters in _inserted(i):
                if j in ENDS:
                    ends.append((cost + INSERT * len(letters), rank, letters, rope))
                    break
        cost, _, letters, rope = min(ends, key=lambda e: e[:3])
        out = [letters]
        while rope is not None:
            rope, *step = rope
            step = tuple(step)
            if step not in self.texts:
                self.texts[step] = audit_of(self.grammar.matrices[step[0]], *step[1:])
            out.append(self.texts[step])
        return cost, "".join(reversed(out))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> the rows without their texts, equal ones as one, with `initial`, `fault` of the
    first copy and `again`, that of the others.

    A text is known by its first 64 characters, for the order, and a digest. Whether it was said before in its conversation
    follows from the least turn of (conversation, role, digest): groups shrink within each task before they are shuffled,
    and adaptive execution splits the rows of a hot one in the join."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keys = rows.select("conv_id", "turn", "role", *_order(), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("open"), "copies")
    keys = keys.groupBy(*(c for c in keys.columns if c != "copies")).agg(F.sum("copies").alias("copies"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # nulls first
    first = keys.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"))
    keys = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").drop("c", "r", "d")
    fault = F.when(F.col("blank"), BLANK).when(turn != F.col("first"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(OK)
    return keys.select("conv_id", "turn", "role", "head", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.when(F.col("blank"), BLANK).otherwise(DUPLICATE).alias("again"), "copies")


def _order() -> list[Column]:
    """What orders rows of one turn and role."""
    return [F.substring("text", 1, 64).alias("head"), F.unhex(F.md5("text")).alias("digest")]


def pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> (conv_id, part, piece, symbols): every conversation's symbols in the order of
    (part, piece), none empty unless nothing is left of a conversation. Rows are dealt by ranges of (conversation, turn, role,
    text), so a conversation of a third of all rows lies in many tasks; pieces are bounded."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "digest")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = _faults(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "initial", "fault", "again", "copies")

    def run(batches):
        part, n, conv, begun, held, out, conv_type = TaskContext.get().partitionId(), 0, None, False, [], [], None

        def put(symbols: str) -> None:
            nonlocal n
            out.append((conv, part, n, symbols))
            n += 1

        def batch_of():
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((conv_type, pa.int32(), pa.int64(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "piece", "symbols"])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for next_conv, initial, fault, again, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or next_conv != conv:
                    if begun:
                        put("".join(held))
                        held.clear()
                    conv, begun = next_conv, True
                k = 0
                while k < copies:  # equal rows: the first, then its repeats, however many
                    if len(held) >= PIECE:
                        put("".join(held))
                        held.clear()
                    more = 1 if k == 0 else min(copies - k, PIECE - len(held))
                    held += [symbol(initial, fault if k == 0 else again)] * more
                    k += more
                if len(out) >= 2_000:
                    yield batch_of()
            if out:
                yield batch_of()
        if begun:
            put("".join(held))
            yield batch_of()

    return dealt.mapInArrow(run, f"conv_id {kind}, part int, piece long, symbols string")


def _pairs(sequences: DataFrame, grammar_rules: list[str]) -> DataFrame:
    """(pair, n): how often each pair of neighbours stands in all sequences as the rules so far leave them; of equal
    symbols in a row, every second pair."""

    def run(batches):
        grammar, found = Grammar(grammar_rules), Counter()
        for batch in batches:
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, skip = grammar.compressed(s), False
                for a, b, c in zip(s, s[1:], s[2:] + "\0", strict=False):
                    if skip:
                        skip = False
                        continue
                    found[a + b] += n
                    skip = a == b == c
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return sequences.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def fit_grammar(symbols: DataFrame, rounds: int = ROUNDS, rules_a_round: int = RULES_A_ROUND) -> list[str]:
    """Re-Pair over all pieces (equal ones counted together), in rounds: the most frequent pairs become rules, as many
    at once as do not touch one another, since those would take away each other's places."""
    sequences = cut(symbols.filter("symbols <> ''").groupBy("symbols").agg(F.count("*").alias("n")))
    rules: list[str] = []
    for _ in range(rounds):
        best = _pairs(sequences, rules).filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * rules_a_round).collect()  # bounded by the parameter
        taken: list[str] = []
        for row in best:
            a, b = row["pair"]
            if len(taken) < rules_a_round and all(b != c and a != d for c, d in taken):
                taken.append(row["pair"])
        if not taken:
            break
        rules += taken
    return rules


def decisions(symbols: DataFrame, rules: list[str]) -> DataFrame:
    """Pieces -> (conv_id, illegal, blank, duplicate, truncated, cost, audit), a row a conversation. A conversation's
    compressed pieces stream in order; equal conversations of one piece are solved once a task."""
    kind = symbols.schema["conv_id"].dataType.simpleString()
    dealt = symbols.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "piece").select("conv_id", "symbols")

    def run(batches):
        grammar, known, conv, begun, held, solver, out = Grammar(rules), {}, None, False, "", None, []

        def answer() -> tuple:
            if solver is not None:
                solver.add(held)
                return (*solver.counts, *solver.end())
            if held not in known:
                if len(known) >= 20_000:
                    known.clear()
                one = Solver(grammar)
                one.add(held)
                known[held] = (*one.counts, *one.end())
            return known[held]

        for batch in batches:
            for next_conv, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and next_conv == conv:
                    solver = solver or Solver(grammar)
                    solver.add(held)
                    held = s
                    continue
                if begun:
                    out.append((conv, *answer()))
                conv, begun, held, solver = next_conv, True, s, None
            yield batch_of(out, batch.schema.field(0).type)
            last_type = batch.schema.field(0).type
        if begun:
            out.append((conv, *answer()))
            yield batch_of(out, last_type)

    def batch_of(out, conv_type):
        types = (conv_type, *[pa.int64()] * 5, pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["conv_id", "illegal", "blank", "duplicate", "truncated", "cost", "audit"])
        out.clear()
        return batch

    return dealt.mapInArrow(run, f"conv_id {kind}, illegal long, blank long, duplicate long, truncated long, cost long, audit string")


class _Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _put(self, initial: str) -> str:
        role = NEXT_ROLE[self.state]
        self.state = STEP[self.state, initial or role[0]]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put(""), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._put(role[:1])
            yield role, text
        elif letter == "R":
            yield self._put(""), text


def _stream(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Every conversation's decision followed by its rows in order, in one partition; texts are shuffled here only."""
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("turn", "role", "text")}
    said = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *_order(), "copies", F.lit(None).cast("string").alias("audit"))
    heads = decided.select("conv_id", F.lit(0).alias("kind"), *(v.alias(c) for c, v in none.items()), F.lit(None).cast("string").alias("head"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(rows.schema["copies"].dataType).alias("copies"), "audit")
    order = ["conv_id", "kind", "turn", "role", "head", "digest"]
    return heads.unionByName(said).repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(c) for c in order))


def repaired_turns(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        repair, conv, at, out = None, None, 0, []
        conv_type = None

        def put(turns) -> None:
            nonlocal at
            for role, text in turns:
                out.append((conv, at, role, text))
                at += 1

        def batch_of():
            batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((conv_type, pa.int64(), pa.string(), pa.string()))], ["conv_id", "position", "role", "text"])
            out.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if repair:
                        put(repair.inserted())
                    repair, conv, at = _Repair(r["audit"]), r["conv_id"], 0
                else:
                    for _ in range(r["copies"]):
                        put(repair.row(r["role"], r["text"]))
            yield batch_of()
        if repair:
            put(repair.inserted())
            yield batch_of()

    return _stream(rows, decided).select("conv_id", "kind", "role", "text", "copies", "audit").mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def _digests(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired `role:text` lines: a hash is a chain, so a conversation streams through one
    task, which holds one row and the audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        repair, conv, state, lines, out, conv_type = None, None, sha256(), 0, [], None

        def put(turns) -> None:
            nonlocal lines
            for role, text in turns:
                state.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                lines += 1

        def batch_of():
            batch = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], conv_type), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])
            out.clear()
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for next_conv, which, role, text, copies, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if which == 0:
                    if repair:
                        put(repair.inserted())
                        out.append((conv, state.hexdigest()))
                    repair, conv, state, lines = _Repair(audit), next_conv, sha256(), 0
                else:
                    for _ in range(copies):
                        put(repair.row(role, text))
            yield batch_of()
        if repair:
            put(repair.inserted())
            out.append((conv, state.hexdigest()))
            yield batch_of()

    return _stream(rows, decided).select("conv_id", "kind", "role", "text", "copies", "audit").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def decided_by(rows: DataFrame) -> DataFrame:
    """The decisions on (conv_id, turn, role, text, copies), with a grammar fitted to all of them; kept, for what follows."""
    symbols = cut(pieces(rows))
    return cut(decisions(symbols, fit_grammar(symbols)))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, one row a conversation. `copies` says how often a row stands there; with 0 it only names its
    conversation, and a conversation of such rows has zeros, an empty audit and the hash of an empty string.

    Rows of a conversation come by turn (nulls first), those of one turn by role, by the text's first 64 characters and then
    by its MD5; equal rows follow one another. Roles and texts must not be null. A role without an initial of s, u or a, the
    empty one too, can be kept nowhere. A null conversation is one like any other; other columns are not read."""
    decided = decided_by(rows)
    turns = rows.filter("copies > 0 and turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.sum("one")).cast("long").alias("gaps"))
    digests = _digests(rows, decided).withColumnRenamed("conv_id", "e")
    out = decided.join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("e")))
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations as the query damages them, by the checksum of `conv_id:turn`; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(what == 4, "user").otherwise(space("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long").alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """DuckDB SQL for the query: the pattern's four states row after row, each with its least (cost, audit)."""
    w = r"[\x20\x09-\x0D]"
    s = lambda c, a: f"{{'c': {c}, 'a': {a}}}"
    ins = lambda x, n: s(f"{x}.c + {INSERT * n}", f"{x}.a || '{'I' * n}'")
    put = lambda x, cost, letter: s(f"{x}.c + {cost}", f"{x}.a || '{letter}'")
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    keep = lambda x, initial: f"case when stays and initial = '{initial}' then {put(x, 'more', 'K')} else {s('1000000000', repr('~'))} end"
    rerole = lambda x: f"case when stays then {put(x, 'more + 1', 'R')} else {s('1000000000', repr('~'))} end"
    e2, e3 = least("s2", ins("s0", 1), ins("s1", 1), ins("s3", 1)), least("s3", ins("s2", 1), ins("s0", 2), ins("s1", 2))
    none = s("1000000000", "'~'")
    return rf"""with recursive bytes as (select conv_id, turn, string_split(key, '') as chars from (select distinct conv_id, turn,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations)),
crc as (select conv_id, turn, chars, 1 as nr, cast(4294967295 as bigint) as crc from bytes
  union all select conv_id, turn, chars, nr + 1, (select {_crc_steps()} from (select xor(crc, cast(ord(chars[nr]) as bigint)) as c0)) from crc where nr <= len(chars)),
what as (select conv_id, turn, xor(crc, 4294967295) % 20 as k from crc where nr = len(chars) + 1),
hurt as (select c.conv_id, c.turn, case when k = 4 then 'user' else coalesce(role, ' ') end as role,
  case when k = 1 then '' when k = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text, case k when 0 then 0 when 3 then 2 else 1 end as copies
  from conversations c join what w on c.conv_id is not distinct from w.conv_id and c.turn is not distinct from w.turn),
rows_ as (select *, row_number() over (partition by conv_id, role, text order by pos) as nth from (select conv_id, turn, role, text,
  row_number() over (partition by conv_id order by turn nulls first, role, left(text, 64), md5(text)) as pos from hurt, range(copies) r(i))),
marked as (select *, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?]{w}*$') then 'truncated' else 'ok' end as fault from rows_),
dp as (select conv_id, cast(0 as bigint) as pos, {s("0", "''")} as s0, {none} as s1, {none} as s2, {none} as s3 from (select distinct conv_id from conversations)
  union all select conv_id, pos, {put("s0", 2, "D")}, {least(put("s1", 2, "D"), keep("s0", "s"))},
    {least(put("e2", 2, "D"), *(f(x) for x in ("s0", "s1", "e3") for f in (lambda x: keep(x, "u"), rerole)))}, {least(put("e3", 2, "D"), keep("e2", "a"), rerole("e2"))}
  from (select d.conv_id, m.pos, m.initial, m.fault in ('ok', 'truncated') as stays, case when m.fault = 'truncated' then 5 else 0 end as more, s0, s1, {e2} as e2, {e3} as e3
    from dp d join marked m on d.conv_id is not distinct from m.conv_id and m.pos = d.pos + 1)),
best as (select conv_id, {least("s0", "s3", ins("s2", 1), ins("s1", 2))} as b from dp
  where pos = (select count(*) from marked m where m.conv_id is not distinct from dp.conv_id)),
letters as (select conv_id, i, substr(b.a, cast(i as bigint), 1) as letter, length(regexp_replace(left(b.a, cast(i as bigint)), 'I', '', 'g')) as pos from best, range(1, 100000) r(i) where i <= length(b.a)),
kept_ as (select l.conv_id, i, letter, m.role, m.text, row_number() over (partition by l.conv_id order by i) as nth,
  first_value(letter = 'K' and m.initial = 's') over (partition by l.conv_id order by i) as headed
  from letters l left join marked m on l.conv_id is not distinct from m.conv_id and l.pos = m.pos and letter <> 'I' where letter <> 'D'),
fixed as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (nth - cast(headed as int)) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i)) as h from kept_ group by conv_id),
seen as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(cast(fault = 'blank' as int)) as blank,
  sum(cast(fault = 'duplicate' as int)) as duplicate, sum(cast(fault = 'truncated' as int)) as truncated, sum(cast(pos > 1 and not both_ in ('su', 'ua', 'au') as int)) as illegal
  from (select *, coalesce(lag(initial) over (partition by conv_id order by pos), '') || initial as both_ from marked) group by conv_id)
select b.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
  cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(b.b.c as bigint) as cost, b.b.a as audit, coalesce(f.h, sha256('')) as repaired_sha256
from best b left join seen s on b.conv_id is not distinct from s.conv_id left join fixed f on b.conv_id is not distinct from f.conv_id"""


def _crc_steps() -> str:
    """Eight shifts of a CRC-32 register by one byte, one over the other."""
    x = "c0"
    for k in range(8):
        x = f"list_transform([{x}], lambda x{k}: case when x{k} & 1 = 1 then xor(x{k} >> 1, 3988292384) else x{k} >> 1 end)[1]"
    return x


ORACLE = _oracle()
