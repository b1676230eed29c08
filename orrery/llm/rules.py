"""Quality rules kept in a ledger of failure bits.

`measure` reads every whole text once. `ledger` evaluates every rule once on those figures and stores one bit for each
rule that fails. Policies are named sets of rules: applying one, or another version of one, is a test of bits, and so is
the ablation that says what each rule of a policy rejects alone. Neither reads a text again.

Words are runs of characters other than space and U+0009 to U+000D. Edge cases: a null, empty or blank text has no words
and fails `few_words`; repeated rows are judged each; null ids are passed through; empty tables give empty results. Only
the two columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaim")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a run of five words that the text holds at least twice, the first time included."""
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, upto = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + WINDOW - max(upto, i)
            upto = i + WINDOW
    return covered


def measures(text: str | None) -> tuple[int, ...]:
    """The figures named in MEASURES."""
    text = text or ""
    data = text.encode()
    words = data.split()
    in_words = sum(map(len, words))
    without = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return (len(words), len(text) - (len(data) - in_words), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(LETTERS), without(UPPER), data.count(b"!"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and a long column for each measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(text.as_py()) for text in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a SQL condition on the measures, holds. Its bit never changes or moves to another rule."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 16 * n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 8 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "upper_case", "10 * n_upper > 6 * n_letters"),
    Rule(7, "exclamations", "10 * n_exclaim > 3 * n_words"),
    Rule(8, "few_letters", "2 * n_letters < word_chars"),
)

#: Versions of policies: the rules whose failure rejects a document.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeats"),
    ("web", 1): ("few_words", "repeats", "symbols", "duplicate_lines"),
    ("web", 2): ("few_words", "repeats", "symbols", "short_words", "long_words", "duplicate_lines", "upper_case", "exclamations"),
    ("ascii", 1): tuple(rule.name for rule in RULES),
}


def policy_bits(name: str, version: int, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy's rules."""
    bits = {rule.name: 1 << rule.bit for rule in rules}
    return sum(bits[rule] for rule in POLICIES[name, version])


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`measured` and `failed`, whose bits are the rules that fail."""
    failed = F.lit(0).cast("long")
    for rule in rules:
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def rejects(bits: int) -> Column:
    """Whether a ledger row fails any rule of these bits."""
    return F.col("failed").bitwiseAND(F.lit(bits).cast("long")) != 0


def ablation(ledger_rows: DataFrame, name: str, version: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that all others together reject.

    Rows are first counted by their bits, of which there are at most 2 ** rules.
    """
    bits = policy_bits(name, version, rules)
    by_bits = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(bits).cast("long")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    own = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in rules if bits >> r.bit & 1]
    each = by_bits.select("failed", "n", F.explode(F.array(*own)).alias("r")).select("failed", "n", "r.rule", "r.own")
    counted = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule").agg(
        counted(F.col("failed").bitwiseAND(F.col("own")) != 0).alias("n_failed"),
        counted(F.col("failed") == F.col("own")).alias("n_only"),
        counted(F.col("failed").bitwiseAND(F.bitwise_not("own")) != 0).alias("n_rejected_without"),
        F.sum("n").alias("n_documents"),
    )


def judged_rows(docs: DataFrame, name: str = "web", version: int = 2, text_col: str = "text") -> DataFrame:
    """`doc` (a whole row of `docs`, ids or not) and whether it is `kept` under a policy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(text.as_py()) for text in batch.column(0).field(text_col)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", *MEASURES])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    measured = rows.mapInArrow(run, rows.withColumns({m: F.lit(0).cast("long") for m in MEASURES}).schema)
    return ledger(measured).select("doc", (~rejects(policy_bits("base", 1) | policy_bits(name, version))).alias("kept"))


def judged(docs: DataFrame, name: str = "web", version: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of `docs` with `base_failed` and `kept` under a policy. What fails the base policy is never kept."""
    rows = ledger(measure(docs, id_col, text_col))
    base = policy_bits("base", 1)
    return rows.withColumn("base_failed", rejects(base)).withColumn("kept", ~rejects(base | policy_bits(name, version)))
