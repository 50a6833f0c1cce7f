"""Quality rules (operator 11): rules of single documents, and verdicts on whole hosts, in DataFrame functions only.

Every document's numbers are taken once and kept. Failures of each rule are summed by host; a host's rate is shrunk towards
that of all documents with a beta prior fitted to the spread of rates between hosts (a host of few documents says
little), and a host goes if even the low end of a rule's shrunk rate shows that most of its documents fail, and many more
than elsewhere. The verdicts are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Rules over a document's numbers, as SQL. The first two reject the document itself; all of them count against its host.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "copied_lines": "100 * n_dup_lines > 30 * n_lines",
    "odd_words": "word_chars > 12 * n_words or word_chars < 2 * n_words",
}
BASE = ("short", "repeated")
#: A host goes if the mean of its shrunk rate less DEVIATIONS standard deviations exceeds both MOST and TIMES the rate of all documents.
MOST, TIMES, DEVIATIONS = 0.5, 2.0, 3.0
#: The prior's strength, in documents, is kept within these; the last also stands where hosts do not differ more than chance has it.
WEAKEST, STRONGEST = 2.0, 1000.0
WINDOW = 3
_WHITE = r"[\x20\x09-\x0D]+"


def host(source: Column) -> Column:
    """The host that a source names, a URL or a bare name, in lower case without `www.`; null if it names none."""
    name = F.regexp_extract(F.lower(source), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)
    return F.when(name != "", name)


def with_numbers(df: DataFrame) -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of column `text`,
    which is dropped. Null text has none.

    Steps that later ones read more than once are columns of their own, so that they are computed once a row. Repeated
    windows are found by sorting their hashes, each with its position in the low bits: neighbours whose high bits and
    whole 64-bit hashes agree are equal windows. Time grows as n log n with a text's length."""
    text = F.coalesce("text", F.lit(""))
    df = df.withColumn("_words", F.array_remove(F.split(text, _WHITE), ""))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # a window's hash takes its words one after another, so that words cannot run together; the last positions start none
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WINDOW))))
    df = df.select(
        *(c for c in df.columns if c not in ("text", "_words", "_lines")),
        F.size("_words").cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("_words", "")), F.lit(0)).cast("long").alias("word_chars"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, F.slice(hashes, F.lit(1), F.size("_words") - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # most texts repeat no window: no need to sort theirs
    df = df.withColumn("_windows", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_low", F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("_windows")))) - 1, F.lit(0).cast("long")))
    packed = F.transform("_windows", lambda h, i: F.coalesce(h.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long")), F.lit(0).cast("long")))
    df = df.withColumn("_sorted", F.sort_array(packed))

    def equal(x: Column, y: Column) -> Column:
        high = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not("_low")) == 0
        at = lambda z: F.get("_windows", z.bitwiseAND(F.col("_low")).cast("int"))
        return F.coalesce(high & (at(x) == at(y)), F.lit(False))

    again = F.filter("_sorted", lambda x, i: equal(x, F.get("_sorted", i - 1)) | equal(x, F.get("_sorted", i + 1)))
    df = df.withColumn("_again", F.transform(again, lambda x: x.bitwiseAND(F.col("_low")))).drop("_sorted", "_windows", "_low")
    add = lambda k, x: x + k
    covered = F.col("_again")
    for k in range(1, WINDOW):
        covered = F.array_union(covered, F.transform("_again", partial(add, F.lit(k))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_again")


def host_failures(documents: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(host, n and a count of failures for each rule) of documents with their numbers; rows without a host are left out."""
    failed = [F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in rules.items()]
    return documents.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *failed)


def prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """(mean, strength) of the beta prior of a rule's failure rate: the rate of all documents, and by how many documents'
    worth it counts. By the analysis of variance between and within hosts, which weighs hosts by their size."""
    n, k = F.col("n").cast("double"), F.col(rule).cast("double")
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(rule).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn")).first()  # one row of sums
    if not row["hosts"]:
        return 0.0, STRONGEST
    mean = row["k"] / row["n"]
    if row["hosts"] < 2 or row["n"] == row["hosts"]:
        return mean, STRONGEST
    between = (row["kk"] - row["k"] * row["k"] / row["n"]) / (row["hosts"] - 1)
    within = (row["k"] - row["kk"]) / (row["n"] - row["hosts"])
    size = (row["n"] - row["nn"] / row["n"]) / (row["hosts"] - 1)
    spread = between + (size - 1) * within
    if between <= within or spread <= 0:
        return mean, STRONGEST
    return mean, min(STRONGEST, max(WEAKEST, spread / (between - within) - 1))


def with_verdicts(hosts: DataFrame, priors: Mapping[str, tuple[float, float]]) -> DataFrame:
    """`hosts` with each rule's shrunk rate as <rule>_rate, and `rejected`."""
    bad = F.lit(False)
    for rule, (mean, strength) in priors.items():
        total = F.col("n") + F.lit(strength)
        rate = (F.col(rule) + F.lit(mean * strength)) / total
        hosts = hosts.withColumn(f"{rule}_rate", rate)
        low = F.col(f"{rule}_rate") - DEVIATIONS * F.sqrt(F.greatest(F.col(f"{rule}_rate") * (1 - F.col(f"{rule}_rate")), F.lit(0.0)) / (total + 1))
        bad = bad | ((low > MOST) & (low > TIMES * mean))
    return hosts.withColumn("rejected", bad)


def judged(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(doc_id, text, source) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, a row
    for each row. `kept` is false for rows that fail a base rule and for all rows of rejected hosts.

    Null text is empty (and fails, being short). Null or empty sources name no host: their rows stand for themselves.
    Repeated rows count each; other columns are not read; an empty table gives an empty one. Only a host's counts are
    shuffled, and numbers without texts for the join, in which adaptive execution broadcasts few rejected hosts and splits
    a host of many rows if there are many."""
    numbers = cut(with_numbers(docs.select("doc_id", host(F.col("source")).alias("host"), "text")))
    hosts = cut(host_failures(numbers, rules))
    verdicts = with_verdicts(hosts, {rule: prior(hosts, rule) for rule in rules})
    out = numbers.join(verdicts.filter("rejected").select("host", "rejected"), "host", "left")
    failed = F.expr(" or ".join(f"({rules[r]})" for r in BASE if r in rules))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


def op11_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


def _rule_sql() -> str:
    """DuckDB SQL for the query; the prior's sums and bounds as above, with the rules' own texts."""
    sums = ", ".join(f"sum(cast({rule} as bigint)) as k_{r}" for r, rule in RULES.items())
    fits, joins = [], []
    for r in RULES:
        fits.append(
            f"""p_{r} as (select coalesce(sk / sn, 0) as mean, case when h < 2 or sn = h or between_ <= within_ or between_ + (size_ - 1) * within_ <= 0 then {STRONGEST}
  else least({STRONGEST}, greatest({WEAKEST}, (between_ + (size_ - 1) * within_) / (between_ - within_) - 1)) end as strength
from (select h, sn, sk, (kk - sk * sk / sn) / nullif(h - 1, 0) as between_, (sk - kk) / nullif(sn - h, 0) as within_, (sn - nn / sn) / nullif(h - 1, 0) as size_
from (select count(*) as h, cast(sum(n) as double) as sn, cast(sum(k_{r}) as double) as sk, sum(cast(k_{r} as double) * k_{r} / n) as kk, sum(cast(n as double) * n) as nn from hosts)))"""
        )
        joins.append(f"select host from (select host, p.mean, n + p.strength as total, (k_{r} + p.mean * p.strength) / (n + p.strength) as rate from hosts, p_{r} p) where rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (total + 1)) > greatest({MOST}, {TIMES} * mean)")
    base = " or ".join(f"({RULES[r]})" for r in BASE)
    return rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
  nullif(regexp_extract(lower(source), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?(?:www\.)?([^/:?#]*)', 1), '') as host from documents),
w as (select rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select rid, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from win) where n > 1),
covered as (select rid, count(distinct i + k) as n from again, (values (0), (1), (2)) t(k) group by rid),
num as (select w.rid, doc_id, host, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
from w left join covered on w.rid = covered.rid),
hosts as (select host, count(*) as n, {sums} from num where host is not null group by host),
{", ".join(fits)},
bad as ({" union ".join(joins)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed,
  not ({base}) and (host is null or host not in (select host from bad)) as kept from num"""


ORACLE = _rule_sql()
