"""Guardrail for free-text corrections that a language model proposes.

The word alignment has no relational form: an Arrow-batched helper gives the
blocks that differ. The rules over those blocks are column expressions.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions import text

_BLOCKS = "array<struct<kind: string, old: array<string>, new: array<string>>>"


def differing_blocks(old: Column, new: Column) -> Column:
    """Blocks of an alignment of two lists of words that are not equal: replace, insert or delete."""

    def align(a, b) -> list[tuple]:
        a, b = list(a), list(b)
        return [(kind, a[i:j], b[k:m]) for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"]

    @F.pandas_udf(_BLOCKS)
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([align(a, b) for a, b in zip(old, new, strict=True)], dtype=object)

    return run(old, new)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def unwrapped(proposed: Column) -> Column:
    """A model's output without blanks and quotation marks around it; empty for null."""
    out = F.coalesce(proposed, F.lit(""))
    for sign in (r"\s", '"', "'", r"\s"):
        out = F.regexp_replace(out, rf"(?U)^{sign}+|{sign}+\z", "")
    return out


def corrected(original: Column, proposed: Column, max_edit: int = 2, max_words: int = 2, max_share: float = 0.3, least: int = 2, word_splits: bool = False) -> Column:
    """The proposal, unwrapped and without an end mark it added, where it mends spellings only; else the original.

    The number of words may differ by ``max_words``. A replaced block must keep
    its number of words (unless ``word_splits`` and its joined letters change
    by ``max_edit`` edits at most), and each of its words may change by
    ``max_edit`` edits; case does not count. At most ``max_share`` of the
    words, rounded half to even, may be touched, but always ``least``. A null
    original counts as empty; a null or blank proposal leaves the original.
    """
    original = F.coalesce(original, F.lit(""))
    new = unwrapped(proposed)
    ended = text.without_added_end(original, new)
    old_words, new_words = words(original), words(ended)
    blocks = differing_blocks(old_words, new_words)
    edits = lambda a, b: F.levenshtein(F.lower(a), F.lower(b))

    def fits(b: Column) -> Column:
        alike = F.forall(F.zip_with(b["old"], b["new"], edits), lambda n: n <= max_edit)
        joined = edits(F.array_join(b["old"], ""), F.array_join(b["new"], "")) <= max_edit if word_splits else F.lit(False)
        return F.when(b["kind"] != "replace", True).when(F.size(b["old"]) == F.size(b["new"]), alike).otherwise(joined)

    touched = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.greatest(F.size(b["old"]), F.size(b["new"])))
    bound = F.greatest(F.lit(least), F.bround(F.lit(max_share) * F.size(old_words)).cast("int"))
    mends = (F.abs(F.size(old_words) - F.size(new_words)) <= max_words) & F.forall(blocks, fits) & (touched <= bound)
    return F.when((new != "") & mends, ended).otherwise(original)
