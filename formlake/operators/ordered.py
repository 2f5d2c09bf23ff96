"""Operators over ordered rows: top two, profiles, islands, continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked_option(shares: DataFrame, keys: list[str], share: str = "share", option: str = "option", order: str = "ord", least: float = 0.02, margin: float = 0.15) -> DataFrame:
    """(keys, best, top, second, margin, status): the option with most ink, if it leads clearly."""
    w = Window.partitionBy(*keys).orderBy(F.desc(share), order)
    two = shares.withColumn("_k", F.row_number().over(w)).filter("_k <= 2")
    out = two.groupBy(*keys).agg(F.max(F.when(F.col("_k") == 1, F.col(option))).alias("best"), F.max(F.when(F.col("_k") == 1, F.col(share))).alias("top"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col(share))), F.lit(0.0)).alias("second"))
    out = out.withColumn("margin", (F.col("top") - F.col("second")) / (F.col("top") + F.lit(1e-6)))
    return out.withColumn("status", F.when(F.col("top") < least, "no_mark").when(F.col("margin") < margin, "ambiguous").otherwise("ok"))


def moving_average(profile: Column, window: int = 5) -> Column:
    """Averages of an array over an odd window, the ends repeated outwards."""
    half = window // 2
    n = F.size(profile)
    at = lambda i: F.get(profile, F.greatest(F.lit(0), F.least(i, n - 1)))
    total = lambda i: sum((at(i + k) for k in range(-half + 1, half + 1)), at(i - half))
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(i) / window))


def local_maxima(profile: Column) -> Column:
    """Indices that are at least their left and above their right neighbour: a plateau counts at its last index."""
    low = F.lit(float("-inf"))
    n = F.size(profile)
    peak = lambda i: (F.get(profile, i) >= F.when(i == 0, low).otherwise(F.get(profile, F.greatest(i - 1, F.lit(0))))) & (F.get(profile, i) > F.coalesce(F.get(profile, i + 1), low))
    return F.filter(F.sequence(F.lit(0), n - 1), peak)


def prominences(profile: Column) -> Column:
    """Array of struct<i, prominence> of the local maxima: how far one must descend from a peak to reach higher ground.

    Each side's base is the lowest value up to the next higher one; a side on
    which nothing rises above the peak has its lowest value.
    """

    def base(side: Column, top: Column) -> Column:
        higher = F.array_position(F.transform(side, lambda x: x > top), F.lit(True)).cast("int")
        own = F.when(higher > 0, F.slice(side, F.lit(1), F.greatest(higher - 1, F.lit(0)))).otherwise(side)
        return F.least(top, F.coalesce(F.array_min(own), top))

    def of(i: Column) -> Column:
        top = F.get(profile, i)
        left, right = F.reverse(F.slice(profile, F.lit(1), i)), F.slice(profile, i + 2, F.size(profile))
        return F.struct(i.alias("i"), (top - F.greatest(base(left, top), base(right, top))).alias("prominence"))

    return F.transform(local_maxima(profile), of)


def islands(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """(keys, island, low, high, n): runs of rows whose neighbours lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n"))


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add ``run``: the number of the stretch of equal ``value`` that a row lies in."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    return rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(fresh)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def continued(rows: DataFrame, keys: list[str], order: str, value: str, text: str, separator: str = " ") -> DataFrame:
    """(keys, run, value, text, n): the texts of each run joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    grouped = runs(rows, keys, order, value).groupBy(*keys, "run", value)
    return grouped.agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias(text), F.count("*").alias("n"))


def next_matching(rows: DataFrame, keys: list[str], order: str, value: Column, wanted: Column, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the next later row where ``wanted`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(wanted, value), ignorenulls=True).over(w))


def token_spans(tokens: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Add ``s`` and ``e``: the character span of each token when all are put together."""
    w = Window.partitionBy(*keys).orderBy(order)
    return tokens.withColumn("e", F.sum(F.length(text)).over(w)).withColumn("s", F.col("e") - F.length(text))


def boundaries(profile: Column) -> Column:
    """Array of struct<left, right, cut>: the lowest place between neighbouring peaks, the first of equally low ones."""
    peaks = local_maxima(profile)

    def between(right: Column, k: Column) -> Column:
        left = F.get(peaks, k)
        valley = F.slice(profile, left + 1, right - left + 1)
        return F.struct(left.alias("left"), right.alias("right"), (left + F.array_position(valley, F.array_min(valley)).cast("int") - 1).alias("cut"))

    return F.transform(F.slice(peaks, F.lit(2), F.greatest(F.size(peaks) - 1, F.lit(0))), between)
