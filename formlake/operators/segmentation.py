"""Lines of a handwritten crop: peaks, bands, seams, and ink components with their lines.

Profiles and costs are array columns and all steps over them expressions. Only
the labelling of connected ink needs imperative code: one Arrow pass per batch
of crops turns pixels into runs with a component number; votes, straddling and
what to do with lone dots are joins and groupings over these runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from formlake.functions.text import let


def merged_peaks(profile: Column, peaks: Column, most: float = 0.35) -> Column:
    """Peaks left when neighbours without a deep valley between them are merged, the shallowest first.

    A valley's depth is its lowest value as a share of the lower peak. As long as the
    largest share is above ``most``, the lower peak of that pair goes (of equal
    ones the right); of equal shares the leftmost pair. Between peaks of
    height 0 there is no valley.
    """
    height = lambda i: F.get(profile, i)

    def step(kept: Column, _: Column) -> Column:
        def share(b: Column, k: Column) -> Column:
            a = F.get(kept, k)
            return F.coalesce(F.try_divide(F.array_min(F.slice(profile, a + 1, b - a + 1)).cast("double"), F.least(height(a), height(b)).cast("double")), F.lit(1.0))

        shares = F.transform(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), share)

        def merged(s: Column) -> Column:
            k = F.array_position(s, F.array_max(s)).cast("int")
            a, b = F.get(kept, k - 1), F.get(kept, k)
            return F.when(F.array_max(s) > most, F.array_remove(kept, F.when(height(a) < height(b), a).otherwise(b))).otherwise(kept)

        return F.when(F.size(kept) > 1, let(shares, merged)).otherwise(kept)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(peaks), F.lit(1))), peaks, step)


def _median(values: Column) -> Column:
    n = F.size(values)
    return let(F.array_sort(values), lambda v: (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2)


def spaced_peaks(profile: Column, peaks: Column, least: float = 0.30) -> Column:
    """Of peaks nearer than ``least`` times the median distance the taller stays (of equal ones the first); two peaks or fewer stay as they are."""
    gaps = F.transform(F.slice(peaks, F.lit(2), F.greatest(F.size(peaks) - 1, F.lit(0))), lambda b, k: b - F.get(peaks, k))

    def spaced(pitch: Column) -> Column:
        def step(kept: Column, q: Column) -> Column:
            last = F.element_at(kept, -1)
            taller = F.when(F.get(profile, q) > F.get(profile, last), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(q))).otherwise(kept)
            return F.when(q - last < least * pitch, taller).otherwise(F.concat(kept, F.array(q)))

        return F.aggregate(F.slice(peaks, F.lit(2), F.size(peaks)), F.slice(peaks, F.lit(1), F.lit(1)), step)

    return F.when(F.size(peaks) <= 2, peaks).otherwise(let(_median(gaps), spaced))


def peak_bands(profile: Column, peaks: Column, body: float) -> Column:
    """Array of struct<top, bottom> (bottom excluded): the rows around each peak that stay above ``body`` times its height."""

    def band(i: Column) -> Column:
        low = lambda x: x <= body * F.get(profile, i)
        reach = lambda side: let(F.array_position(F.transform(side, low), F.lit(True)).cast("int"), lambda k: F.when(k > 0, k - 1).otherwise(F.size(side)))
        up, down = F.reverse(F.slice(profile, F.lit(1), i)), F.slice(profile, i + 2, F.size(profile))
        return F.struct((i - reach(up)).cast("int").alias("top"), (i + reach(down) + 1).cast("int").alias("bottom"))

    return F.transform(peaks, band)


def seam_cost(columns: Column, straight: Column | int, wander: float) -> Column:
    """Costs of a band given by its columns of ink (0 to 1): ink, and ``wander`` times the distance from the row ``straight`` as a share of the rows."""
    straight = F.lit(straight) if isinstance(straight, int) else straight
    return F.transform(columns, lambda c: F.transform(c, lambda ink, y: ink.cast("double") + wander * F.abs(y - straight) / F.size(c)))


def seam(cost: Column) -> Column:
    """struct<cost, path>: the cheapest way from the first column to the last, one row per column, moving a row at most.

    ``cost`` is an array of columns. Of equally cheap ways the one with the upper
    last row, and from there with the upper row before. No columns, or columns
    without rows, give null.
    """
    start = F.struct(F.get(cost, 0).alias("sums"), F.array().cast("array<array<int>>").alias("moves"))

    def step(s: Column, column: Column) -> Column:
        near = lambda y: F.array(*[F.struct(F.coalesce(F.get(s["sums"], y + d), F.lit(float("inf"))).alias("c"), F.lit(d).alias("d")) for d in (-1, 0, 1)])
        best = F.transform(column, lambda _, y: F.array_min(near(y)))
        return let(best, lambda b: F.struct(F.zip_with(column, b, lambda c, x: c + x["c"]).alias("sums"), F.concat(s["moves"], F.array(F.transform(b, lambda x: x["d"]))).alias("moves")))

    def back(s: Column) -> Column:
        low = F.array_min(s["sums"])
        end = (F.array_position(s["sums"], low) - 1).cast("int")
        walk = lambda path, m: F.concat(path, F.array(F.element_at(path, -1) + F.get(m, F.element_at(path, -1))))
        return F.struct(low.alias("cost"), F.reverse(F.aggregate(F.reverse(s["moves"]), F.array(end), walk)).alias("path"))

    summed = F.aggregate(F.slice(cost, F.lit(2), F.greatest(F.size(cost) - 1, F.lit(0))), start, step)
    return F.when(F.size(F.get(cost, 0)) > 0, let(summed, back))


def labelled_runs(ink: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(component, y, x0, x1) of the runs of ink in every row, x1 excluded; runs that touch, corners included, share a component: the number of its first run."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), x1 = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    root = list(range(len(y)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    firsts = np.searchsorted(y, np.arange(len(ink) + 1))
    for row in range(1, len(ink)):
        above, here, end = firsts[row - 1], firsts[row], firsts[row + 1]
        stop = here
        while above < stop and here < end:
            if x0[above] <= x1[here] and x0[here] <= x1[above]:
                a, b = find(above), find(here)
                root[max(a, b)] = min(a, b)
            if x1[above] < x1[here]:
                above += 1
            else:
                here += 1
    return [(find(k), int(y[k]), int(x0[k]), int(x1[k])) for k in range(len(y))]


def ink_runs(crops: DataFrame, key: str) -> DataFrame:
    """(key, component, y, x0, x1) of ``crops`` (key, w, ink): ``ink`` a row-wise array of 0 and 1 (null: none), ``w`` the width. A crop without ink has no runs."""
    out = StructType([crops.schema[key]])
    for name in ("component", "y", "x0", "x1"):
        out = out.add(name, IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, (w, ink) in enumerate(zip(b["w"].to_pylist(), b["ink"], strict=True)):
                values = np.array(ink.values.fill_null(0).to_numpy(zero_copy_only=False) if ink.is_valid else [], bool)
                found = labelled_runs(values.reshape(-1, w)) if w and len(values) else []
                at += [k] * len(found)
                rows += found
            columns = [pa.array(c, pa.int32()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int64())), *columns], names=[key, "component", "y", "x0", "x1"])

    return crops.select(key, F.col("w").cast("int").alias("w"), F.col("ink").cast("array<int>").alias("ink")).mapInArrow(run, out)


def assigned_runs(runs: DataFrame, lines: DataFrame, key: str, straddle: float = 1.0) -> DataFrame:
    """Add to every run the ``line`` that its component belongs to.

    ``lines``: (key, line, top, bottom, band_top, band_bottom, peak), bottoms excluded, a
    crop's windows without overlap. A component votes with the ink that lies in the
    bands, where a line's writing is, and belongs to the line with most of it (of equal ones
    the lower line): a flourish that reaches into another line's gap does not count. A
    component that has at least the share ``straddle`` of its ink in a second window is
    divided by windows. One without ink in any band, a dot or an accent, goes with the
    component that shares columns with it and is nearest above or below (ties:
    the first), else to the line whose peak is nearest its centre.
    """
    runs = runs.withColumn("n", F.col("x1") - F.col("x0"))
    of = runs.join(lines.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")), "left").drop("_key")
    in_band = (F.col("y") >= F.col("band_top")) & (F.col("y") < F.col("band_bottom"))
    votes = of.groupBy(key, "component", "line").agg(F.sum(F.when(in_band, F.col("n")).otherwise(0)).alias("body"), F.sum("n").alias("ink"))
    by_ink = Window.partitionBy(key, "component").orderBy(F.desc("ink"))
    told = votes.withColumn("_k", F.row_number().over(by_ink)).groupBy(key, "component").agg(
        F.max_by(F.when(F.col("body") > 0, F.col("line")), F.struct("body", "line")).alias("owner"),
        (F.coalesce(F.sum(F.when(F.col("_k") == 2, F.col("ink"))), F.lit(0)) >= straddle * F.sum("ink")).alias("divided"),
    )
    shape = runs.groupBy(key, "component").agg(
        F.min("x0").alias("l"), F.max("x1").alias("r"), F.min("y").alias("t"), (F.max("y") + 1).alias("b"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("cy")
    )
    parts = told.join(shape, [key, "component"])
    lone, sure = parts.filter("owner is null"), parts.filter("owner is not null").select(F.col(key).alias("_key"), F.col("component").alias("c2"), F.col("owner").alias("o2"), *[F.col(c).alias(c + "2") for c in "lrtb"])
    met = lone.join(sure, (F.col(key) == F.col("_key")) & (F.col("r2") > F.col("l")) & (F.col("l2") < F.col("r")))
    nearest = met.groupBy(key, "component").agg(F.min_by("o2", F.struct(F.greatest(F.col("t2") - F.col("b"), F.col("t") - F.col("b2")), F.col("c2"))).alias("near"))
    peaks = lone.join(lines.select(F.col(key).alias("_key"), F.col("line").alias("pl"), "peak"), F.col(key) == F.col("_key")).groupBy(key, "component").agg(F.min_by("pl", F.struct(F.abs(F.col("cy") - F.col("peak")), F.col("pl"))).alias("by_peak"))
    owners = parts.join(nearest, [key, "component"], "left").join(peaks, [key, "component"], "left")
    owners = owners.select(key, "component", F.coalesce("owner", "near", "by_peak").alias("owner"), (F.col("divided") & F.col("owner").isNotNull()).alias("divided"))
    return of.select(key, "component", "y", "x0", "x1", "line").join(owners, [key, "component"]).select(key, "component", "y", "x0", "x1", F.when(F.col("divided"), F.col("line")).otherwise(F.col("owner")).alias("line"))
