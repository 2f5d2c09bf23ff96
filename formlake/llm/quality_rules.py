"""Quality rules as a bitmask ledger.

Each document is measured once and every rule is evaluated once; the ledger
keeps the measurements and one bit per failed rule. A policy is a version name
and the set of rules that it applies, so trying another policy, or leaving one
rule out, is a bitwise test over stored rows: no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_shouts", "n_bars", "n_letters", "n_stutters")

#: Rules in the order of their bits; each is true where the document fails. A new rule goes last.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "capitals": "10 * n_upper_words > 5 * n_words",
    "shouting": "10 * n_shouts > 2 * n_words",
    "menus": "10 * n_bars > 2 * n_words",
    "repeated_lines": "n_lines >= 10 and 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "few_letters": "10 * n_letters < 4 * word_chars",
    "stutter": "10 * n_stutters > 3 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the policy: documents that fail one of ``rules`` go."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: dict[str, str] | None = None) -> int:
        """The policy's bits in a ledger of ``rules`` (RULES by default); a rule that the ledger lacks raises ValueError."""
        names = list(RULES if rules is None else rules)
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
CURRENT = Policy("2", tuple(RULES))
POLICIES = (BASE, Policy("1", ("too_few_words", "repeated_windows", "symbols", "repeated_lines")), CURRENT)


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):  # exact: the code so far is renumbered whenever the next word may overflow it
        if k > 1 and int(code.max()) >= (1 << 62) // len(seen):
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(seen) + ids[k : k + n]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    at = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of the ledger's columns."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        text.count("!!"),
        words.count(b"|"),
        _letters(text),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def _letters(text: str) -> int:
    """ASCII letters and characters beyond ASCII."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int((((codes | 32) - 97 < 26) | (codes > 127)).sum())


def _measured(texts: pa.Array) -> list[pa.Array]:
    rows = [measure(x or "") for x in texts.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_MEASURES)
    return [pa.array(c, pa.int64()) for c in columns]


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, measurements (long), and ``failed``, the bits of the failed rules.

    Null and empty texts measure zero everywhere; a null id stays null;
    repeated rows are judged each; an empty table gives an empty ledger; columns
    of ``docs`` other than the two named are not read. ``rules`` maps names to
    SQL conditions over the measurements, at most 63, RULES by default.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_measured(b.column(1))], names=["id", *_MEASURES])

    measured = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in _MEASURES))
    return measured.select(F.col("id").alias(id_col), *_MEASURES, _failures(rules).alias("failed"))


def _failures(rules: dict[str, str] | None) -> Column:
    """The bits of the rules that the measurements fail."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(0).cast("long") for k, rule in enumerate((RULES if rules is None else rules).values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def passes(policy: Policy, failed: str | Column = "failed", rules: dict[str, str] | None = None) -> Column:
    """True where a row of the ledger, made with ``rules``, fails none of the policy's rules."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask(rules))) == 0


def keep(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns, whatever their names; the text is measured beside its row, so nothing is joined."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).cast("string").alias("t"))
    measured = StructType([rows.schema["doc"], *(StructField(m, LongType()) for m in _MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_measured(b.column(1))], names=["doc", *_MEASURES])

    return rows.mapInArrow(run, measured).filter(passes(policy, _failures(None))).select("doc.*")


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: dict[str, str] | None = None) -> DataFrame:
    """(version, rule, n_kept, n_kept_without, only_failure): effects of leaving out one rule of a policy.

    ``rows``: a ledger, made with ``rules``. The ledger shrinks to a count per failure pattern first,
    at most two to the number of rules.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    names = list(RULES if rules is None else rules)
    table = spark.createDataFrame([(p.version, p.mask(rules), r, 1 << names.index(r)) for p in policies for r in p.rules], "version string, mask long, rule string, bit long")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    joined = patterns.join(F.broadcast(table), F.lit(True))  # the policy table is fixed and a few rows long
    rest = hit.bitwiseAND(F.bitwise_not("bit"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return joined.groupBy("version", "rule").agg(count(hit == 0).alias("n_kept"), count(rest == 0).alias("n_kept_without"), count(hit == F.col("bit")).alias("only_failure"))
