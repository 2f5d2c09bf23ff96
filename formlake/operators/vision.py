"""Page images: crops and pixel kernels, run by Spark over image rows.

Kernels are small numpy functions on one crop; Spark reads, distributes and
shuffles the pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id long, path string, h int, w int, channels int, data binary"
CROPS = "doc_id long, field string, h int, w int, channels int, data binary"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder, RGB or grey; a file that cannot be decoded raises an error. The id is the last digit run of the file's name."""
    rows = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    stem = F.regexp_extract("origin", r"([^/]+)\.[^./]+$", 1)
    number = F.nullif(F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("bigint")
    fine = F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), F.col("origin"))))
    return rows.select(number.alias("doc_id"), F.col("origin").alias("path"), fine.cast("int").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")


def pixels(h: int, w: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, channels) if channels > 1 else np.frombuffer(data, np.uint8).reshape(h, w)


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def median_blur(image: np.ndarray, k: int = 3) -> np.ndarray:
    """Median of an odd square window, edges repeated."""
    if k % 2 == 0:
        raise ValueError("the window must be odd")
    padded = np.pad(image, k // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (k, k)), axis=(2, 3)).astype(np.uint8)


def otsu_level(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    n0, w0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (w0[-1] * n0 - w0 * n0[-1]) ** 2 / (n0 * (n0[-1] - n0))
    return int(np.argmax(np.nan_to_num(spread, nan=-1.0, posinf=-1.0)))


def crop_to_text(image: np.ndarray, dark: int = 200, pad: int = 5) -> np.ndarray:
    """The part that holds ink, with a margin; the whole image where there is none."""
    ys, xs = np.nonzero(image < dark)
    if not len(ys):
        return image
    return image[max(0, ys.min() - pad) : ys.max() + pad + 1, max(0, xs.min() - pad) : xs.max() + pad + 1]


def line_bands(image: np.ndarray, gap: int = 5, least: int = 8, pad: int = 2) -> list[tuple[int, int]]:
    """Row ranges of text lines: runs of rows with ink, gaps up to ``gap`` bridged, low ones dropped."""
    rows = np.flatnonzero((image < otsu_level(image) + 1).any(axis=1))
    if not len(rows):
        return []
    cuts = np.flatnonzero(np.diff(rows) > gap)
    low, high = rows[np.concatenate(([0], cuts + 1))], rows[np.concatenate((cuts, [len(rows) - 1]))]
    return [(max(0, int(a) - pad), min(len(image), int(b) + pad + 1)) for a, b in zip(low, high, strict=True) if b - a + 1 >= least]


def crops(pages: DataFrame, rois: DataFrame) -> DataFrame:
    """One row per page and field: the box of ``rois`` (field, x1, y1, x2, y2) cut to the page; an empty box gives an empty crop."""
    met = pages.join(F.broadcast(rois), F.lit(True))  # every page has every field of the layout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b.itertuples():
                image = pixels(p.h, p.w, p.channels, p.data)[max(0, p.y1) : max(0, p.y2), max(0, p.x1) : max(0, p.x2)]
                out.append((p.doc_id, p.field, *image.shape[:2], p.channels, np.ascontiguousarray(image).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "field", "h", "w", "channels", "data"])

    return met.mapInPandas(run, CROPS)


def recognised(parts: DataFrame, engine: Callable[[], Callable[[list[np.ndarray]], list[str]]]) -> DataFrame:
    """(doc_id, field, value) of crops; ``engine()`` loads a recogniser once per task. Empty crops read ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for b in batches:
            full = (b["h"] > 0) & (b["w"] > 0)
            images = [pixels(c.h, c.w, c.channels, c.data) for c in b[full].itertuples()]
            values = read(images) if images else []
            if len(values) != len(images):
                raise ValueError("the engine must return one text per crop")
            out = b[["doc_id", "field"]].assign(value="")
            out.loc[full, "value"] = values
            yield out

    return parts.mapInPandas(run, "doc_id long, field string, value string")
