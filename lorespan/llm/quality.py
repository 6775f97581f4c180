"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. Its failure is one bit of `fail_bits`, and what it
measured stays beside it, so that a policy is a mask over bits: applying another version of a
policy, or asking what a rule alone decides, never reads a text again.

Defined results: a null or blank text has no words (all measurements 0) and fails the rule on
few words; repeated rows are judged one by one; columns of the input with the name of a
measurement are dropped in favour of it, all others pass through; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, column, item, let, positions, where_settled, words

WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A document fails when `fails` (over the measured columns) is true."""

    bit: int
    name: str
    fails: Column

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        known = {r.name: r.mask for r in rules}
        return sum(known[name] for name in self.rules)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "has_letter")
VERDICTS = ("fail_bits", "base_failed", "kept")


def default_rules() -> list[Rule]:
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", c("n_symbols") > c("n_words")),
        Rule(3, "repeated_lines", (c("n_lines") >= 5) & (100 * c("n_dup_lines") > 80 * c("n_lines"))),
        Rule(4, "word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words"))),
        Rule(5, "no_letters", ~c("has_letter")),
    ]


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", (*BASE.rules, "symbols")),
    Policy("v2", (*BASE.rules, "symbols", "repeated_lines", "word_length", "no_letters")),
)


def _repeat_words(w: Column) -> Column:
    """Words inside windows of three that the array holds twice or more.

    Hashes tell whether any window repeats; only then the windows themselves are sorted, so
    equality is exact and the work n log n for any text.
    """
    n = F.size(w) - (WINDOW - 1)
    three = lambda i: [item(w, i + k) for k in range(WINDOW)]
    hashes = F.transform(positions(n), lambda i: F.xxhash64(*three(i)))
    ranked = F.sort_array(
        F.transform(positions(n), lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("g"), i.alias("p")))
    )
    twice = lambda s: F.filter(
        s,
        lambda x, i: item(s, i - 1)["g"].eqNullSafe(x["g"]) | item(s, i + 1)["g"].eqNullSafe(x["g"]),
    )
    starts = let(ranked, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))
    covered = let(
        starts,
        lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), item(at, i + 1) - p)),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) < n, covered).otherwise(0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every measurement of MEASURES, beside the columns of the input."""
    body = F.coalesce(column(docs, text), F.lit(""))
    doc, back = carried(docs, [*MEASURES, *VERDICTS])
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(doc, body.alias("body"), words(body).alias("words"), lines.alias("lines"))
    w, body, lines = F.col("words"), F.col("body"), F.col("lines")
    return split.select(
        *back,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        let(w, _repeat_words).cast("bigint").alias("n_repeat_words"),
        body.rlike(r"\p{L}").alias("has_letter"),
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """Measurements and `fail_bits`: bit b is set when the rule with that bit fails."""
    rules = rules or default_rules()
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own, from 0 to 62")
    measured = measure(docs, text)
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(r.mask)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: Policy, rules: Sequence[Rule] | None = None, bits: str = "fail_bits") -> Column:
    """The policy's verdict on a ledger row."""
    mask = F.lit(policy.mask(rules or default_rules())).cast("bigint")
    return F.col(bits).bitwiseAND(mask) == 0


def ablations(
    book: DataFrame,
    policies: Sequence[Policy] = POLICIES,
    rules: Sequence[Rule] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """For each policy and rule of it: how many documents fail the rule, how many only it
    removes, and how many would stay without it. Works on the distinct bit patterns, counted
    once; a ledger of any size shrinks to a few rows per group before anything is compared."""
    rules = rules or default_rules()
    named: Mapping[str, Rule] = {r.name: r for r in rules}
    patterns = book.groupBy(*by, "fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(
                F.lit(p.version).alias("policy"),
                F.lit(name).alias("rule"),
                F.lit(p.mask(rules)).cast("bigint").alias("mask"),
                F.lit(named[name].mask).cast("bigint").alias("bit"),
            )
            for p in policies
            for name in p.rules
        ]
    )
    bits = F.col("fail_bits")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    return (
        patterns.select(*by, "fail_bits", "n", F.explode(cases).alias("c"))
        .select(*by, "fail_bits", "n", "c.*")
        .groupBy(*by, "policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            count(bits.bitwiseAND(F.col("bit")) != 0)("n_fail"),
            count(bits.bitwiseAND(F.col("mask")) == F.col("bit"))("n_only"),
            count(bits.bitwiseAND(F.col("mask")) == 0)("n_kept"),
            count(bits.bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not("bit"))) == 0)("n_kept_without"),
            F.bit_or(F.when(bits.bitwiseAND(F.col("bit")) != 0, bits.bitwiseAND(F.col("mask")))).alias("fails_with"),
        )
    )


def judge(docs: DataFrame, policy: Policy = POLICIES[-1], text: str = "text") -> DataFrame:
    """The ledger with `base_failed` and `kept` under the policy."""
    return ledger(docs, text=text).withColumns({"base_failed": ~passes(BASE), "kept": passes(policy)})


def accepted(docs: DataFrame, policy: Policy = POLICIES[-1], text: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    doc, back = carried(docs)
    row = docs.select(doc, column(docs, text).alias("text"))
    return where_settled(judge(row, policy), F.col("kept")).select(*back)
