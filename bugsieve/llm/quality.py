"""Rule bitmask ledger: every rule is evaluated once, policies read the stored bits.

``ledger`` makes one narrow pass over the texts and adds the measurements and ``fail_bits``,
one bit per rule.  A policy is a versioned set of rules; applying another version, or asking
what each rule costs, reads the stored bits and never the texts again.  Everything is a
built-in column expression: no shuffle, no Python.

Cases: a null or empty text has no words, all measurements 0, and fails ``few_words``.  Very
long texts are handled whole in n log n.  Repeated rows and null ids each keep their own row.
A column of the input whose name an output needs is replaced by it; all others pass through.
Three-word windows are compared by a 64-bit hash of their words, within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.functions.text import let
from bugsieve.llm.common import BLANKS, blank_words, free_name

WINDOW = 3

#: Rule names; a rule's bit is its place in this list, so new rules go to the end.
RULES = ["few_words", "repeated_windows", "symbol_heavy", "odd_word_length", "repeated_lines"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    least_words: int = 50
    repeat_percent: int = 50
    symbols_per_100_words: int = 20
    least_word_length: float = 1.5
    most_word_length: float = 20.0
    repeated_line_percent: int = 50


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbol_heavy"],
    "v2": ["few_words", "repeated_windows", "symbol_heavy", "odd_word_length", "repeated_lines"],
}


def bits_of(policy: str | list[str]) -> int:
    """The mask of a policy, given by version or as a list of rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << RULES.index(n) for n in names)


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
    )

    def repeated(ordered: Column) -> Column:
        # Equal windows are neighbours once sorted.
        found = F.filter(
            ordered,
            lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
        )
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    covered = F.aggregate(
        let(F.sort_array(windows), repeated),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n")
        ),
        lambda a: a["n"],
    )
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(covered)


def _measures(text: Column) -> Column:
    """All measurements of one text as a struct; words and lines are split once."""

    def of(words: Column, lines: Column) -> Column:
        n_lines = F.size(lines)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_window_words(words).alias("n_repeat_words"),
            n_lines.cast("long").alias("n_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return let(blank_words(text), lambda words: let(lines, lambda found: of(words, found)))


def _failures(limits: Limits) -> dict[str, Column]:
    words = F.col("n_words")
    mean_length = F.col("word_chars") / F.greatest(words, F.lit(1))
    return {
        "few_words": words < limits.least_words,
        "repeated_windows": 100 * F.col("n_repeat_words") > limits.repeat_percent * words,
        "symbol_heavy": 100 * F.col("n_symbols") > limits.symbols_per_100_words * words,
        "odd_word_length": (words > 0)
        & ((mean_length < limits.least_word_length) | (mean_length > limits.most_word_length)),
        "repeated_lines": 100 * F.col("n_dup_lines") > limits.repeated_line_percent * F.col("n_lines"),
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def ledger(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``: bit k is set if rule k fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    made = [*MEASURES, "fail_bits"]
    if text in made:
        raise ValueError(f"the text column must not be called {text}")
    m = free_name(docs, "_measures")
    # A generator gives the struct out once; a projection would compute it for each field again.
    measured = docs.drop(*made).withColumn(m, F.explode(F.array(_measures(whole))))
    spelled = measured.select("*", f"{m}.*").drop(m)
    failures = _failures(limits)
    bits = reduce(
        lambda a, b: a.bitwiseOR(b), [F.when(failures[r], 1 << k).otherwise(0) for k, r in enumerate(RULES)]
    )
    return spelled.withColumn("fail_bits", bits.cast("long"))


def passes(policy: str | list[str], bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(bits_of(policy))) == 0


def ablations(rows: DataFrame, policy: str | list[str]) -> DataFrame:
    """What each rule of a policy costs: ``(rule, failed, only_by_this, kept, kept_without)``.

    The rows are first counted by bit pattern, at most 2 to the number of rules of them, so
    the shuffle carries one small row per pattern and task.
    """
    mask = bits_of(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits_of([r])).alias("bit")) for r in names])
    n_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    b, bit = F.col("b"), F.col("x.bit")
    return (
        patterns.withColumn("x", F.explode(rules))
        .groupBy(F.col("x.rule").alias("rule"))
        .agg(
            n_if(b.bitwiseAND(bit) != 0)("failed"),
            n_if(b == bit)("only_by_this"),
            n_if(b == 0)("kept"),
            n_if((b == 0) | (b == bit))("kept_without"),
        )
    )


def keep(docs: DataFrame, text: str = "text", policy: str | list[str] = "v2", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass the policy, with the columns they came with."""
    columns = docs.columns
    inner = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    )
    return ledger(inner, "_text", limits).filter(passes(policy)).select("_row.*")
