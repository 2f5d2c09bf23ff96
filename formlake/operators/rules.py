"""Correction rules: a name, and a column that keeps the value unless a checked correction exists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions import dates, text
from formlake.operators.matching import nearest_entries

#: Rule by field type where a field names none.
DEFAULT_RULE = {"number": "numeric"}


def none(c: Column) -> Column:
    return c


def numeric(c: Column, pattern: str | None = None) -> Column:
    """Look-alike letters to digits, only where the result fits the pattern and the value did not."""
    if pattern is None:
        return c
    anchored = f"^(?:{pattern})"
    mapped = text.digit_map(c)
    return F.when(c.rlike(anchored), c).when(mapped.rlike(anchored), mapped).otherwise(c)


def date(c: Column) -> Column:
    return F.coalesce(dates.corrected_spelled_date(c), dates.corrected_numeric_date(c))


def name(c: Column) -> Column:
    return F.when(F.trim(c) == "", c).otherwise(text.clean_name(c))


def _nearest(plain: Column, entries: Sequence[str], within: Column) -> Column:
    """Struct (d, k, e) of the nearest of a few entries, or null beyond ``within``."""
    best = F.array_min(F.array(*[F.struct(F.levenshtein(plain, text.for_matching(F.lit(e))).alias("d"), F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(entries)]))
    return F.when(best["d"] <= within, best)


def email(c: Column, domains: Sequence[str], ratio: float = 0.34) -> Column:
    """Lower case, no blanks; a domain near a known one becomes it. Ties: the domain first in the alphabet."""
    plain = text.without_blanks(c)
    domain = text.email_domain(plain)
    best = _nearest(domain, sorted(domains), F.lit(ratio) * F.greatest(F.length(domain), F.lit(1)))
    near = F.concat(text.email_local(plain), F.lit("@"), best["e"])
    return F.when(F.instr(plain, "@") == 0, plain).when(domain.isin(*domains), plain).otherwise(F.coalesce(near, plain))


def street_suffix(c: Column, suffixes: Sequence[str], ratio: float = 0.34) -> Column:
    """The end of a street name corrected to a known suffix: the last hyphen part whole, else a trailing stretch.

    Limit: the suffix length times ``ratio``, halves to even, one at least. The
    nearest suffix wins, then the one earlier in the list, then a stretch as
    long as the suffix, then the shorter one. After a hyphen it is capitalised,
    else in lower case.
    """
    v = F.trim(c)
    last = F.element_at(F.split(v, "-"), -1)
    hyphen = F.instr(v, "-") > 0
    options = []
    for k, s in enumerate(suffixes):
        n, most = len(s), max(1, round(ratio * len(s)))
        for rank, w in enumerate((n, n - 1, n + 1)):
            tail = F.right(v, F.lit(w))
            d = F.levenshtein(F.lower(tail), F.lit(s.lower()))
            options.append(F.when(~hyphen & (F.length(v) >= max(1, w)) & (d <= most), F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(rank).alias("r"), F.lit(w).alias("w"))))
        d = F.levenshtein(F.lower(last), F.lit(s.lower()))
        options.append(F.when(hyphen & (d <= most), F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(0).alias("r"), F.length(last).alias("w"))))
    best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    names = F.array(*map(F.lit, suffixes))
    found = F.get(names, best["k"])
    ending = F.when(hyphen, F.initcap(found)).otherwise(F.lower(found))
    return F.when(best.isNull(), v).otherwise(F.concat(F.left(v, F.length(v) - best["w"]), ending))


RULES: dict[str, Callable[..., Column]] = {"none": none, "numeric": numeric, "date": date, "name": name, "email": email, "street_suffix": street_suffix}


def lexicon(cells: DataFrame, entries: DataFrame, ratio: float = 0.34, value: str = "value") -> DataFrame:
    """``cells`` with ``value`` replaced by its nearest list entry (in matching form) within the ratio.

    ``entries``: (entry, ord). Distinct values only meet the list.
    """
    listed = entries.select("entry", "ord", text.for_matching(F.col("entry")).alias("plain"))
    values = cells.select(F.col(value).alias("raw")).distinct().withColumn("plain", text.for_matching(F.col("raw")))
    near = nearest_entries(values.select(F.col("plain").alias("value")), listed.groupBy("plain").agg(F.min("ord").alias("ord")).select(F.col("plain").alias("entry"), "ord"), ratio)
    first = listed.groupBy("plain").agg(F.min_by("entry", "ord").alias("entry"))
    found = near.select(F.col("value").alias("p"), F.col("entry").alias("plain")).join(first, "plain").select("p", F.col("entry").alias("fixed"))
    table = values.join(listed.select(F.col("entry").alias("raw")).distinct(), "raw", "left_anti").join(found, F.col("plain") == F.col("p")).select(F.col("raw").alias("_raw"), "fixed")
    return cells.join(table, F.col(value) == F.col("_raw"), "left").withColumn(value, F.coalesce("fixed", value)).drop("_raw", "fixed")


def corrected(cells: DataFrame, fields: Sequence[tuple[str, str, str | None]], domains: Sequence[str] = (), suffixes: Sequence[str] = (), name: str = "value") -> DataFrame:
    """Apply each field's rule to its cells. ``fields``: (field, rule, pattern); fields not named pass through. ``name``: the column for the result."""
    v = F.col("value")
    out = v
    for field, rule, pattern in fields:
        args = {"numeric": (pattern,), "email": (domains,), "street_suffix": (suffixes,)}.get(rule, ())
        out = F.when(F.col("field") == field, RULES[rule](v, *args)).otherwise(out)
    return cells.withColumn(name, out)
