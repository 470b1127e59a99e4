"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one bit for each failed
rule; policies are masks over those bits, so a new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name_of, schema_of, text_bytes

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
#: Bytes that continue a code point.
_CONTINUE = bytes(range(0x80, 0xC0))
_LETTERS = _UPPER + bytes(range(97, 123))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``condition``, SQL over the measurements, is true.  ``bit`` is its fixed place."""

    bit: int
    name: str
    condition: str


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never given anew: a withdrawn rule keeps its bit, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "shouting", "10 * n_upper > 4 * n_letters"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def _repeated(words: list[bytes], width: int = 3) -> int:
    """Words inside a ``width``-word window that stands at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = ids[:n - width + 1]
    for i in range(1, width):  # dense again after each word, so the product cannot overflow
        key = np.unique(key * len(seen) + ids[i:n - width + 1 + i], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    hit = np.zeros(n + 1, np.int64)
    hit[:n - width + 1] += again
    hit[width:] -= again
    return int(np.count_nonzero(np.cumsum(hit[:n])))


def measure(raw: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of one text given as UTF-8."""
    words = raw.split()
    body = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(body.translate(None, _CONTINUE)),
        len(body) - len(body.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines),
        len(body) - len(body.translate(None, _UPPER)), len(body) - len(body.translate(None, _LETTERS)),
    )


def ledger(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``carry`` columns, the measurements and ``fail_bits``, one row for each row of ``docs``, without a shuffle.

    NULL and empty texts measure 0 everywhere and so fail ``few_words``; repeated rows each get their row; an empty
    table gives an empty ledger.  Names in ``carry`` must not be names of measurements.
    """
    given = docs.select(*[name_of(c).alias(c) for c in carry], text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in batch.column("__text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(found[:, i]) for i in range(len(MEASURES))], [*carry, *MEASURES])

    measured = given.mapInArrow(run, ", ".join([schema_of(given, *carry), *(f"{m} long" for m in MEASURES)]))
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.condition), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in policy.rules)


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES, column: str = "fail_bits") -> Column:
    """Whether a ledger row breaks any rule of the policy."""
    return name_of(column).bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) != 0


def ablations(ledger_df: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does in each policy: rows that fail it, rows that only it rejects, and the rows kept.

    Works on the counts of the distinct bitmasks, of which there are at most two to the number of rules.
    """
    spark = ledger_df.sparkSession
    bits = {r.name: 1 << r.bit for r in rules}
    plan = spark.createDataFrame(
        [(p.name, p.version, name, bits[name], mask_of(p, rules)) for p in policies for name in p.rules],
        "policy string, version int, rule string, bit long, mask long",
    )
    counts = ledger_df.groupBy("fail_bits").count()
    broken = F.col("fail_bits").bitwiseAND(F.col("mask"))
    each = counts.withColumn("one", F.lit(1)).join(F.broadcast(plan.withColumn("one", F.lit(1))), "one")
    return each.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(broken == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only"),
        F.sum(F.when(broken == 0, F.col("count")).otherwise(0)).alias("n_kept"),
    )


def quality_rules(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows with ``base_failed`` and the verdict ``kept`` of base policy and ``policy`` together."""
    rows = ledger(docs, text_col, (id_col,))
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~(fails(BASE) | fails(policy)))
