"""Layouts: the fields of a form, their types, rules and boxes, as small dimension tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("text", "number", "long_text", "checkbox_group", "ignore")
RECOGNISED = ("text", "number", "long_text")


def read_layout(path: str) -> list[dict]:
    """Fields of a layout file, checked: known types, names once, options only in checkbox groups."""
    with open(path, encoding="utf-8") as f:
        return checked(json.load(f))


def checked(document: Mapping) -> list[dict]:
    fields = list(document.get("fields", ()))
    names = [f.get("name") for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("field names must be unique")
    for f in fields:
        if f.get("type") not in TYPES:
            raise ValueError(f"unknown type of field {f.get('name')}: {f.get('type')}")
        if f.get("options") and f["type"] != "checkbox_group":
            raise ValueError(f"options on a field that is no checkbox group: {f['name']}")
        roi = f.get("roi")
        if roi is not None and not (roi[0] < roi[2] and roi[1] < roi[3]):
            raise ValueError(f"empty box of field {f['name']}")
    return fields


def _layout(rows: DataFrame) -> list[str]:
    """The column that tells layouts apart, where there is one."""
    return ["layout"] if "layout" in rows.columns else []


def described(fields: DataFrame) -> DataFrame:
    """Every field with its rule in effect and what becomes of it."""
    rule = F.coalesce("rule", F.when(F.col("type") == "number", "numeric").otherwise("none"))
    return fields.select(*_layout(fields), "ord", "field", "type", rule.alias("rule"), (F.col("type") != "ignore").alias("is_output"), F.col("type").isin(*RECOGNISED).alias("is_recognised"))


def to_relative(boxes: DataFrame, width: int, height: int) -> DataFrame:
    share = lambda c: (F.col(c) / (width if c[0] == "x" else height)).alias(c)
    return boxes.select(*_layout(boxes), "field", *map(share, ("x1", "y1", "x2", "y2")))


def reconciled(schema: DataFrame, layout: DataFrame, keys: Sequence[str] = ("field",)) -> DataFrame:
    """(keys, state): which names both sides know."""
    a, b = (side.select(*[F.col(k).alias(e + k) for k in keys]) for side, e in ((schema, "a_"), (layout, "b_")))
    state = F.when(F.col("a_field").isNull(), "only in layout").when(F.col("b_field").isNull(), "only in schema").otherwise("both")
    met = a.join(b, [F.col("a_" + k) == F.col("b_" + k) for k in keys], "full_outer")
    return met.select(*[F.coalesce("a_" + k, "b_" + k).alias(k) for k in keys], state.alias("state"))


def with_boxes(fields: DataFrame, boxes: DataFrame) -> DataFrame:
    """New boxes where given; fields not named keep theirs."""
    new = boxes.select(F.col("field").alias("_f"), F.col("roi").alias("_roi"))
    return fields.join(new, F.col("field") == F.col("_f"), "left").withColumn("roi", F.coalesce("_roi", "roi")).drop("_f", "_roi")


def prompt(fields: DataFrame) -> DataFrame:
    """One text a layout that names the fields to read, in order."""
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), F.col("field"), F.lit(" ("), F.col("type"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return fields.filter("type <> 'ignore'").groupBy(*_layout(fields)).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "; ").alias("prompt"))
