"""Ink statistics: histograms, thresholds, profiles and boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.text import let
from formlake.operators import ordered


def otsu(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the level that separates a histogram (keys, level, n) best; the lowest of equal ones.

    Between-class variance in exact integers: (total * w0 - n0 * sum)^2 over n0 * n1.
    """
    w = Window.partitionBy(*keys).orderBy("level")
    whole = Window.partitionBy(*keys)
    mass = F.col("level") * F.col("n")
    run = histogram.withColumns({"n0": F.sum("n").over(w), "w0": F.sum(mass).over(w), "n_all": F.sum("n").over(whole), "w_all": F.sum(mass).over(whole)})
    d = (F.col("w_all") * F.col("n0") - F.col("w0") * F.col("n_all")).cast("double")
    spread = F.when(F.col("n_all") > F.col("n0"), d * d / (F.col("n0") * (F.col("n_all") - F.col("n0")))).otherwise(-1.0)
    return run.withColumn("_s", F.round(spread, 6)).groupBy(*keys).agg(F.max_by("level", F.struct("_s", -F.col("level"))).alias("threshold"))


def pooled(pixels: DataFrame, keys: list[str], value: str, contrast: float) -> DataFrame:
    """(keys, median, p95, low, n_distinct, has_contrast) of all pixels of a group."""
    out = pixels.groupBy(*keys).agg(F.round(F.median(value), 6).alias("median"), F.round(F.percentile(value, 0.95), 6).alias("p95"), F.min(value).alias("low"), F.count_distinct(value).alias("n_distinct"))
    return out.withColumn("has_contrast", F.col("p95") - F.col("low") >= contrast)


def ink_ratio(pixels: Column, threshold: Column) -> Column:
    """Share of an array's values at or below the threshold."""
    return F.size(F.filter(pixels, lambda p: p <= threshold)) / F.size(pixels)


def row_profile(pixels: DataFrame, keys: list[str], row: str, ink: str) -> DataFrame:
    return pixels.groupBy(*keys, row).agg(F.sum(ink).alias("ink"))


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def overlap_test(rows: DataFrame, keys: list[str], value: str, marked: str) -> DataFrame:
    """(keys, low_marked, high_unmarked, overlaps): whether one threshold can tell the classes apart."""
    out = rows.groupBy(*keys).agg(F.min(F.when(F.col(marked), F.col(value))).alias("low_marked"), F.max(F.when(~F.col(marked), F.col(value))).alias("high_unmarked"))
    return out.withColumn("overlaps", F.coalesce(F.col("low_marked") <= F.col("high_unmarked"), F.lit(False)))


def group_threshold(pixels: DataFrame, keys: list[str], value: str, contrast: float = 25.0) -> DataFrame:
    """(keys, threshold, dark, inverted): the grey level up to which a pixel of a group counts as ink, one for all its crops.

    The pixels become a histogram first, so that a group costs at most 256 rows. No
    threshold (null) where the darkest pixel is less than ``contrast`` below the
    95th percentile, or where there is one level only. Of two levels the middle;
    else Otsu's, but the middle of percentile and darkest where that is an extreme
    (0 or below, 254 or above). ``dark``: the median is below 128; ``inverted``:
    more than half the pixels would be ink. Both say that the ratios can't be trusted.
    """
    levels = pixels.groupBy(*keys, F.col(value).alias("level")).agg(F.count("*").alias("n")).filter("level is not null")
    stats = levels.groupBy(*keys).agg(
        F.percentile("level", 0.95, F.col("n")).alias("paper"), F.min("level").alias("darkest"), F.percentile("level", 0.5, F.col("n")).alias("median"), F.count("*").alias("n_levels"), F.sum("level").alias("both"), F.sum("n").alias("n_all")
    )
    rows = stats.join(otsu(levels, keys).withColumnRenamed("threshold", "_otsu"), keys)
    middle = (F.col("paper") + F.col("darkest")) / 2
    cut = F.when((F.col("paper") - F.col("darkest") < contrast) | (F.col("n_levels") < 2), None).when(F.col("n_levels") == 2, F.col("both") / 2).when((F.col("_otsu") <= 0) | (F.col("_otsu") >= 254), middle).otherwise(F.col("_otsu"))
    rows = rows.select(*keys, "median", "n_all", cut.cast("double").alias("threshold"))
    ink = levels.join(rows, keys).groupBy(*keys).agg(F.sum(F.when(F.col("level") <= F.col("threshold"), F.col("n")).otherwise(0)).alias("n_ink"))
    return rows.join(ink, keys).select(*keys, "threshold", (F.col("median") < 128).alias("dark"), (2 * F.col("n_ink") > F.col("n_all")).alias("inverted"))


def opened(mask: Column) -> Column:
    """A mask (array of rows of booleans) after opening with a 2 by 2 square: specks without such a square of ink go.

    First a pixel stays if it and its neighbours above, left and above left are ink, those
    beyond the edge counting as ink; then a pixel is ink if one of the four is, those
    beyond the edge not counting.
    """

    def over(rows: Column, outside: bool, joined: Callable[[list[Column]], Column]) -> Column:
        at = lambda y, x: F.coalesce(F.get(F.get(rows, y), x), F.lit(outside))
        return F.transform(rows, lambda r, y: F.transform(r, lambda p, x: joined([p, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)])))

    return let(over(mask, True, lambda four: four[0] & four[1] & four[2] & four[3]), lambda m: over(m, False, lambda four: four[0] | four[1] | four[2] | four[3]))


def ink_shares(crops: DataFrame, keys: list[str], gray: str = "gray", scope: str = "group", opening: bool = True, contrast: float = 25.0) -> DataFrame:
    """Add ``threshold`` and ``share`` (of ink) to ``crops`` (keys, option, ``gray``: an array of rows of grey levels).

    ``scope`` group: one threshold for all options of a group; per_option: Otsu's own
    for each crop. Without a threshold, or without pixels, the share is 0.
    """
    if scope not in ("group", "per_option"):
        raise ValueError(f"scope must be group or per_option, not {scope!r}")
    own = keys if scope == "group" else [*keys, "option"]
    pixels = crops.select(*own, F.explode(F.flatten(gray)).alias("v"))
    if scope == "group":
        cuts = group_threshold(pixels, keys, "v", contrast)
    else:
        cuts = otsu(pixels.groupBy(*own, F.col("v").alias("level")).agg(F.count("*").alias("n")).filter("level is not null"), own)
    met = crops.join(cuts, own, "left")
    mask = F.transform(gray, lambda r: F.transform(r, lambda p: F.coalesce(p <= F.col("threshold"), F.lit(False))))
    ink = F.flatten(opened(mask) if opening else mask)
    return met.withColumn("share", F.coalesce(let(ink, lambda m: F.try_divide(F.size(F.filter(m, lambda p: p)), F.size(m))), F.lit(0.0)))


def checkbox_report(shares: DataFrame, keys: list[str], options: list[str] | None = None) -> DataFrame:
    """(keys, selected, status, margin, threshold, ink_<option>...): a row per group, a column for each option's share.

    ``shares``: (keys, option, ord, share, threshold). The columns are ``options``, else
    all options there are, in order. Groups have null where they lack an option.
    """
    chosen = ordered.marked_option(shares, keys)
    named = sorted(options if options is not None else [r[0] for r in shares.select("option").distinct().collect()])  # a form's few options
    wide = shares.groupBy(*keys).agg(F.round(F.first("threshold"), 1).alias("threshold"), *[F.round(F.first(F.when(F.col("option") == o, F.col("share")), ignorenulls=True), 4).alias(f"ink_{o}") for o in named])
    selected = F.when(F.col("status") == "ok", F.col("best")).alias("selected")
    return chosen.join(wide, keys).select(*keys, selected, "status", F.round("margin", 4).alias("margin"), "threshold", *[f"ink_{o}" for o in named])
