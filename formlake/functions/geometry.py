"""Boxes, angles and pixel budgets as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pixels(relative: Column, extent: Column) -> Column:
    """Relative coordinate to pixel, cut towards zero."""
    return (relative * extent).cast("int")


def clipped(low: Column, high: Column, extent: Column) -> tuple[Column, Column]:
    """Interval in order and inside the page; halves round to even."""
    a, b = F.bround(F.least(low, high)).cast("int"), F.bround(F.greatest(low, high)).cast("int")
    return F.greatest(F.lit(0), F.least(a, extent)), F.greatest(F.lit(0), F.least(b, extent))


def warped_box(x1: Column, y1: Column, x2: Column, y2: Column, h: Sequence[float]) -> dict[str, Column]:
    """Bounding box of the four corners under the homography ``h`` (nine numbers, row by row)."""
    xs, ys = [], []
    for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2)):
        w = h[6] * x + h[7] * y + h[8]
        xs.append((h[0] * x + h[1] * y + h[2]) / w)
        ys.append((h[3] * x + h[4] * y + h[5]) / w)
    return {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}


def folded_angle(degrees: Column) -> Column:
    """Angle modulo a right angle, in (-45, 45]."""
    turned = F.pmod(degrees, F.lit(90))
    return F.when(turned > 45, turned - 90).otherwise(turned)


def within_budget(w: Column, h: Column, tokens: int, patch: int = 28) -> tuple[Column, Column, Column]:
    """Width, height and vision tokens of a page made to fit ``tokens`` patches; never enlarged."""
    most = tokens * patch * patch
    factor = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (w * h)))
    ww, hh = F.floor(w * factor), F.floor(h * factor)
    return ww, hh, F.floor(ww * hh / (patch * patch))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals over the shorter one; 0 where they have no length in common."""
    common, shorter = F.least(a1, b1) - F.greatest(a0, b0), F.least(a1 - a0, b1 - b0)
    return F.when(common <= 0, 0.0).when(shorter <= 0, 1.0).otherwise(common / F.nullif(shorter, F.lit(0)))
