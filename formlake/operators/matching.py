"""Similarity, interval and neighbour joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 32  # of one side of a comparison of all with all, each a key of its own


def nearest_entries(values: DataFrame, entries: DataFrame, ratio: float, value: str = "value", entry: str = "entry", order: str = "ord") -> DataFrame:
    """(value, entry, distance): the nearest list entry of each distinct value, within ``ratio`` of the value's length.

    Exact members are found by a hash join first; only the rest meets the list,
    as an equi-join on lengths that may lie within the ratio (each value asks
    for the few lengths in reach), so neither side is broadcast blindly. Of
    equally near entries the one with the lowest ``order`` wins.
    """
    v = values.select(F.col(value).alias("v")).filter("v is not null").distinct()
    e = entries.select(F.col(entry).alias("e"), F.col(order).alias("o"))
    reach = F.floor(F.lit(ratio) * F.greatest(F.length("v"), F.lit(1))).cast("int")
    exact = v.join(e, F.col("v") == F.col("e"), "left_semi").select("v", F.col("v").alias("e"), F.lit(0).alias("d"))
    rest = v.join(e, F.col("v") == F.col("e"), "left_anti").withColumn("reach", reach)
    asked = rest.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), F.length("v") - F.col("reach")), F.length("v") + F.col("reach"))))
    met = asked.join(e.withColumn("n", F.length("e")), F.col("len") == F.col("n")).withColumn("d", F.levenshtein("v", "e")).filter("d <= reach")
    best = met.groupBy("v").agg(F.min(F.struct("d", "o", "e")).alias("b")).select("v", "b.e", "b.d")
    return exact.unionByName(best).select(F.col("v").alias(value), F.col("e").alias(entry), F.col("d").alias("distance"))


def mutual_nearest(left: DataFrame, right: DataFrame, distance: Column, left_id: str, right_id: str, on: Column | None = None) -> DataFrame:
    """(left_id, right_id, distance) of pairs that are each other's nearest; ties to the smaller id.

    ``on`` is the block condition under which rows may meet. Ids are unique on their side, and
    null ids meet nobody. Pairs are counted down to a row per id and distance where they are
    made, so none is shuffled; the second look, from the right, is only at rows that are somebody's nearest.
    """

    def nearest(asking: DataFrame, asked: DataFrame, own: str, other: str) -> DataFrame:
        """(own, other, distance): one side is dealt into parts that each meet the other side whole."""
        parts = asking.filter(F.col(own).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(own), F.lit(PARTS)).cast("int"))
        whole = asked.filter(F.col(other).isNotNull()).withColumn("_for", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        same = F.col("_part") == F.col("_for")
        met = parts.join(whole, same if on is None else same & on).withColumn("distance", distance)
        least = met.groupBy(own, "distance").agg(F.min(other).alias(other))  # plain values: a minimum of structs would sort all pairs
        return least.groupBy(own).agg(F.min(F.struct("distance", other)).alias("_n")).select(own, f"_n.{other}", "_n.distance")

    forth = nearest(left, right, left_id, right_id)
    chosen = right.join(forth.select(F.col(right_id).alias("_chosen")), F.col(right_id) == F.col("_chosen"), "left_semi")
    back = nearest(chosen, left, right_id, left_id).select(F.col(left_id).alias("_l"), F.col(right_id).alias("_r"))
    return forth.join(back, (F.col(left_id) == F.col("_l")) & (F.col(right_id) == F.col("_r"))).select(left_id, right_id, "distance")


def overlapping(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Rows of one key whose half-open intervals ``a`` and ``b`` share a point: an equi-join with a residual."""
    r = right.withColumnRenamed(key, "_key")
    return left.join(r, (F.col(key) == F.col("_key")) & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))).drop("_key")


def nearest_option(markers: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """(key, marker, option): for every marker (x, y) the option with the least |dx| + |dy| in its document, ties to the lower ``ord``."""
    m = markers.select(key, "marker", F.col("x").alias("mx"), F.col("y").alias("my"))
    met = m.join(options.select(key, "option", "ord", F.col("x").alias("ox"), F.col("y").alias("oy")), key)
    gap = F.abs(F.col("mx") - F.col("ox")) + F.abs(F.col("my") - F.col("oy"))
    return met.groupBy(key, "marker").agg(F.min_by("option", F.struct(gap, F.col("ord"))).alias("option"))


def label_hits(segments: DataFrame, labels: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Segments that open with a label, or hold one behind another: (key, ord, label, anchored).

    ``labels``: (label, prefix_re, strict_re), a form's few labels.
    """
    met = segments.join(F.broadcast(labels), F.rlike(F.col(text), F.col("strict_re")) | F.rlike(F.col(text), F.col("prefix_re")))
    return met.select(key, "ord", "label", F.rlike(F.col(text), F.col("prefix_re")).alias("anchored"))


def bleed_report(cells: DataFrame, examples: DataFrame) -> DataFrame:
    """(field, n_filled, n_hits, rate, example): cells that equal a value shown as an example for their field.

    ``cells``: (doc_id, field, value); ``examples``: (field, value). Empty cells
    do not count; a field without filled cells has a null rate.
    """
    shown = examples.filter("value <> ''").select("field", "value").distinct().withColumn("_hit", F.lit(1))
    met = cells.join(shown, ["field", "value"], "left")
    filled = F.col("value") != ""
    hit = filled & F.col("_hit").isNotNull()
    return met.groupBy("field").agg(
        F.count_if(filled).alias("n_filled"),
        F.count_if(hit).alias("n_hits"),
        F.round(F.try_divide(F.count_if(hit), F.count_if(filled)), 6).alias("rate"),
        F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("doc_id"))).alias("example"),
    )
