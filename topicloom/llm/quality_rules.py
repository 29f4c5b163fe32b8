"""Quality rules as a ledger of bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
failure bit per rule; policies are versioned sets of bits that are applied to the ledger
without reading a text again, and ablations are counts over the distinct bit patterns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import text_udf

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
_STRUCT = ", ".join(f"{m}: bigint" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` (over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused; a changed rule takes a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(5, "shouting", "100 * n_upper > 40 * word_chars"),
    Rule(6, "marks", "2 * n_marks > n_words"),
)


def bits(*names: str) -> int:
    known = {r.name: r.bit for r in RULES}
    return sum(1 << known[n] for n in names)


#: Version -> the rules that reject under it.
POLICIES: Mapping[str, int] = {
    "base-1": bits("few_words", "repeated_words"),
    "full-1": bits(*(r.name for r in RULES)),
    "short-1": bits(*(r.name for r in RULES if r.name != "few_words")),
}


def _repeats(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    wins = list(zip(words, words[1:], words[2:]))
    if len(set(wins)) == len(wins):
        return 0
    seen, again = set(), set()
    for w in wins:
        (again if w in seen else seen).add(w)
    cover = bytearray(len(words))
    for i, w in enumerate(wins):
        if w in again:
            cover[i : i + 3] = b"\1\1\1"
    return sum(cover)


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeats(words),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!") + text.count("?"),
    )


def _measure(column: pa.Array) -> pa.Array:
    found = list(zip(*map(measure_text, column.to_pylist()))) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in found], MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``, bit b set where rule b fails.

    Null and empty texts measure 0 everywhere (so they fail ``few_words``).  Rows are
    judged one by one: repeated rows and null keys pass through unchanged, an empty
    table gives an empty table.  Input columns named like a result column are replaced.
    """
    measured = text_udf(_measure, f"struct<{_STRUCT}>")(F.col(text))
    found = docs.select(F.struct("*").alias("_row"), measured.alias("_measured"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    found = found.select(*own, "_measured.*")
    failed = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    total = failed[0]
    for one in failed[1:]:
        total = total.bitwiseOR(one)
    return found.withColumn("fail_bits", total)


def passes(policy: str | int, fail_bits: str = "fail_bits") -> Column:
    """True where no rule of the policy (a version or a bit set) failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(fail_bits).bitwiseAND(F.lit(mask).cast("long")) == 0


def keep(docs: DataFrame, policy: str = "full-1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns.

    Rows are judged one by one, whatever their key; null and empty texts fail ``few_words`` only.
    """
    judged = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return ledger(judged, "_text").filter(passes(policy)).select("_row.*")


def ablations(found: DataFrame) -> DataFrame:
    """Per policy and rule of it: documents rejected, rejected by this rule, and by no other rule.

    One pass: the ledger is first counted by bit pattern (at most 2^rules rows).  Repeated rows
    count each; an empty ledger gives no row.
    """
    cases = [
        F.struct(F.lit(v).alias("policy"), F.lit(r.name).alias("rule"), F.lit(mask).alias("mask"), F.lit(1 << r.bit).alias("bit"))
        for v, mask in POLICIES.items()
        for r in RULES
        if mask >> r.bit & 1
    ]
    patterns = found.groupBy("fail_bits").agg(F.count("*").alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask").cast("long"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return (
        patterns.select("fail_bits", "n", F.inline(F.array(*cases)))
        .groupBy("policy", "rule")
        .agg(
            total(hit != 0).alias("rejected"),
            total(hit.bitwiseAND(F.col("bit").cast("long")) != 0).alias("by_rule"),
            total(hit == F.col("bit").cast("long")).alias("by_rule_alone"),
        )
    )
