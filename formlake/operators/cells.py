"""The cell relation: one row per document and field, always text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_cells(wide: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, value): missing values are ''."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    return wide.select(key, *texts).unpivot([key], list(fields), "field", "value")


def to_wide(cells: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One column per field in the stated order; what a document lacks is ''."""
    out = cells.groupBy(key).pivot("field", list(fields)).agg(F.first("value"))
    return out.select(key, *[F.coalesce(f, F.lit("")).alias(f) for f in fields])


def change_table(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, field, before, after) of cells in both relations whose values differ."""
    b = before.select(key, "field", F.col("value").alias("before"))
    a = after.select(key, "field", F.col("value").alias("after"))
    return b.join(a, [key, "field"]).filter(~F.col("before").eqNullSafe(F.col("after")))


def changed_cells(cells: DataFrame, key: str, corrected: str = "after", value: str = "value") -> DataFrame:
    """(key, field, before, after) of the cells whose correction, a column beside the value, differs: nothing is joined."""
    return cells.select(key, "field", F.col(value).alias("before"), F.col(corrected).alias("after")).filter(~F.col("before").eqNullSafe(F.col("after")))


def changes_by_field(cells: DataFrame, corrected: str = "after", value: str = "value") -> DataFrame:
    """(field, n_changed, share) of the fields with changes: share of all cells, in one aggregation over the cells."""
    counted = cells.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~F.col(value).eqNullSafe(F.col(corrected))).alias("n_changed"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row per field of the form
    return counted.withColumn("total", total).filter("n_changed > 0").select("field", "n_changed", F.round(F.col("n_changed") / F.col("total"), 6).alias("share"))


def joined_reasons(flags: DataFrame, keys: Sequence[str], order: str = "ord", reason: str = "reason", separator: str = "; ") -> DataFrame:
    """Reasons of a cell in their fixed order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, reason)))
    return flags.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[reason]), separator).alias(reason))


def roundtrip_mismatches(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Cells that are not the same in both relations, cells of one side included."""
    b = to_cells(before, key, fields).withColumnRenamed("value", "before")
    a = to_cells(after, key, fields).withColumnRenamed("value", "after")
    return b.join(a, [key, "field"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
