"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit a rule. A policy is a version name and a
mask of the bits that reject, so a new policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_doubled")

#: Rule -> when a document fails it; a rule's bit is its place here.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "doubled_words": "100 * n_doubled > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(RULES)), Policy("v1-layout", ("few_words", "repeated_words", "symbols", "duplicate_lines")))}


def _without(column: str, chars: str) -> Column:
    return F.char_length(column) - F.char_length(F.translate(column, chars, ""))


def ledger(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc_id, the measurements of every whole text, and failed_bits.

    A null text has no words and fails few_words; an empty table gives an empty ledger; repeated rows are judged alike, each for itself; a
    null doc_id is kept. Only doc_id and text are read, so other columns may have any name. No row is shuffled.
    """
    text = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = text.select("*", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN)).alias("lines"))
    # three-word windows sorted by hash, so that equal ones are neighbours
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    windows = F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)))
    counted = words.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - _without("text", BLANKS)).cast("long").alias("word_chars"),
        _without("text", SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _without("text", CAPITALS).cast("long").alias("n_capitals"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).cast("long").alias("n_doubled"),
        windows.alias("windows"),
    )
    twice = F.filter("windows", lambda x, i: (x["h"] == F.get("windows", i - 1)["h"]) | (x["h"] == F.get("windows", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    measured = counted.select("row", "doc_id", *(F.coalesce(F.size(covered), F.lit(0)).cast("long").alias(m) if m == "n_repeat_words" else m for m in MEASURES))
    measured = measured.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("failed_bits", reduce(Column.bitwiseOR, bits).cast("long"))


def rejected(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(book: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """version, rule, n_rejected, n_only: per policy and rule, the documents that fail it and those that no other rule of it rejects.

    The ledger is first counted by distinct bit pattern, at most 2 to the number of rules, whatever the input. An empty ledger gives no
    rows; repeated rows count each.
    """
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit")) for p in policies.values() for i, r in enumerate(RULES) if r in p.rules]
    hit = F.expr("(failed_bits & p.bit) <> 0")
    only = F.expr("(failed_bits & p.mask) = p.bit")
    return patterns.select("*", F.explode(F.array(*rows)).alias("p")).groupBy("p.version", "p.rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_rejected"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


def judge(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The ledger with base_failed and kept under `policy`; nulls, repeated rows and empty tables as in `ledger`."""
    return ledger(docs).withColumns({"base_failed": rejected(BASE), "kept": ~rejected(BASE) & ~rejected(policy)})


def passing(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of docs that `policy` keeps, with their own columns; no row is shuffled.

    A null or empty text has too few words and goes; repeated rows stay or go together; a null doc_id is kept; an empty table stays empty.

    The column `once` keeps the optimiser from moving the filter below the measurements, which would work each of them out many times.
    """
    book = ledger(docs).select("row", "failed_bits", F.monotonically_increasing_id().alias("once"))
    kept = book.where(~rejected(BASE) & ~rejected(policy) & (F.col("once") >= 0))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
