"""Embedding whitening with exact sums: digit-slice matrix products.

Components become integers, x = floor(scale * c) + offset. The fit list is each
distinct vector once. Every task multiplies its part of the list with itself
through BLAS: integers are cut into limbs of ``BITS`` bits, so that every
entry of a product of two limb matrices of at most ``BLOCK`` rows is an integer
below 2^53, which doubles hold exactly. Limb products are put together as big
integers, sent as 32-bit digits (a row per matrix entry and task, first added
up where they lie), and merged by Spark's sums of digits. A column of ones
beside the vectors gives n and the sums S in the same product. The driver gets
one matrix of the dimension's size, whatever the number of rows: n^2 times the
covariance is n * XX - S * S', exactly, so that no offset, however large beside
the spread, costs a digit. Only then come doubles and the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructType

from formlake.llm.work import materialise

BITS = 16
BLOCK = 1 << 16
#: Blocks whose limb products fit 64 bits together.
_FLUSH = 1 << 10
#: 32-bit digits of an entry: 2^40 rows of 64-bit integers need 168 bits.
_DIGITS = 6
_LARGEST = float(1 << 62)


def integers(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of every component as double, null where the vector or a component is null or not finite; beyond 2^62 a product counts as that."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), F.lit(float(scale)) * c.cast("double")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(held(c)) + F.lit(offset).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles, lowest first, whose values times 2^(BITS * k) add up to ``x``; only the last has signs."""
    out = []
    while x.size and (x.max() >= 1 << BITS or x.min() < -(1 << BITS)):
        out.append((x & ((1 << BITS) - 1)).astype(np.float64))
        x = x >> BITS
    return [*out, x.astype(np.float64)]


class Gram:
    """Adds up x' x of integer blocks exactly."""

    def __init__(self, width: int):
        self.whole = np.zeros((width, width), object)
        self.parts: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        cut = limbs(x)
        for i, a in enumerate(cut):
            for j in range(i, len(cut)):
                g = (a.T @ cut[j]).astype(np.int64)
                held = self.parts.setdefault(i + j, np.zeros(self.whole.shape, np.int64))
                held += g if i == j else g + g.T
        self.blocks += 1
        if self.blocks % _FLUSH == 0:
            self.flush()

    def flush(self) -> np.ndarray:
        for k, g in self.parts.items():
            self.whole += g.astype(object) << (BITS * k)
        self.parts = {}
        return self.whole


def _digits(v: int) -> list[int]:
    return [*((v >> 32 * k) & 0xFFFFFFFF for k in range(_DIGITS - 1)), v >> 32 * (_DIGITS - 1)]


def exact_products(fit: DataFrame, width: int) -> list[list[int]]:
    """The matrix [1 x]' [1 x] over the rows' arrays ``x`` of ``width`` integers, as Python integers."""
    names = [f"d{k}" for k in range(_DIGITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(width + 1)
        for b in batches:
            x = _matrix(b["x"])
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                gram.add(np.hstack([np.ones((len(part), 1), np.int64), part]))
        if gram.blocks:
            whole = gram.flush()
            i, j = np.triu_indices(width + 1)
            digits = [_digits(int(whole[p])) for p in zip(i, j, strict=True)]
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(d, pa.int64()) for d in zip(*digits, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *names])

    rows = fit.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} long" for n in names))
    sums = rows.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names]).collect()  # (width + 1)(width + 2) / 2 rows
    out = [[0] * (width + 1) for _ in range(width + 1)]
    for r in sums:
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = sum(int(r[n]) << 32 * k for k, n in enumerate(names))
    return out


class Model:
    """What a fit list of ``n`` vectors with sums ``s`` gives: eigenvalues in falling order, unit eigenvectors as columns, shares of the whole variance."""

    def __init__(self, products: list[list[int]], most: int):
        self.n, self.s = products[0][0], products[0][1:]
        v = np.array([[(self.n * p - a * b) / self.n**2 for p, b in zip(row[1:], self.s, strict=True)] for row, a in zip(products[1:], self.s, strict=True)], np.float64).reshape(len(self.s), len(self.s))
        e, vectors = np.linalg.eigh(v) if len(v) else (np.zeros(0), np.zeros((0, 0)))
        e, vectors = e[::-1], vectors[:, ::-1]
        k = int((e > len(e) * np.finfo(float).eps * e.max(initial=0)).sum())  # beyond, nothing varies
        self.values, self.vectors = e[: min(k, most)], vectors[:, : min(k, most)]
        self.vectors = self.vectors * np.where(self.vectors[np.abs(self.vectors).argmax(0), range(self.vectors.shape[1])] < 0, -1.0, 1.0) if self.vectors.size else self.vectors
        self.shares = self.values / np.trace(v) if len(self.values) else self.values

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in 64 bits where that is exact, else in Python's integers."""
        most = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.s), default=0)
        exact = np.int64 if most < 1 << 62 else object
        return x.astype(exact) * self.n - np.array(self.s, exact)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        centred = deviations.astype(np.float64) / float(self.n)
        return centred @ self.vectors / np.sqrt(self.values)


def _squares(d: np.ndarray) -> list[Decimal | None]:
    """Sums of squares of rows, exact; null beyond 38 digits."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= float(1 << 62):
        d = d.astype(object)
    total = (d * d).sum(1) if d.shape[1] else np.zeros(len(d), np.int64)
    return [Decimal(int(t)) if int(t) < 10**38 else None for t in total]


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity); 0 without components. Vectors are centred before anything is multiplied."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = model.whitened(model.deviations(_matrix(b["x"])))
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        if total[0, 0]:
            i, j = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = {(r["i"], r["j"]): r["s"] / model.n for r in sums}
    return max(abs(m[i, j] - m[0, i] * m[0, j] - (i == j)) for i in range(1, k + 1) for j in range(i, k + 1))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a finite vector, for each of the first ``components`` components.

    Null vectors and those with a null or non-finite component go. Vectors
    shorter than the longest count as if zeros followed. Equal vectors are one of
    the fit list; each of their rows, also with a repeated or null key, has its
    own results. A component beyond those in which the fit list varies does not
    exist: one distinct vector, or an empty table, gives no rows. ``deviation``
    is decimal(38, 0), null where it has more digits. Other columns are not read.
    """
    x = rows.select(F.col(key).alias("key"), integers(F.col(vector), scale, offset).alias("x")).filter("x is not null")
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    short = F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size("x"))))
    x = x.withColumn("x", F.when(F.size("x") < width, short).otherwise(F.col("x")))
    out = StructType([x.schema["key"]]).add("deviation", DecimalType(38, 0)).add("w", ArrayType(DoubleType(), False))
    fit = materialise(x.select("x").distinct(), "fit")
    model = Model(exact_products(fit, width), components)
    error = identity_error(fit, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = model.deviations(_matrix(b["x"]))
            w = model.whitened(d)
            places = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(places, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(_squares(d), pa.decimal128(38, 0)), lists], names=["key", "deviation", "w"])

    shares = F.array(*map(F.lit, model.shares.tolist())).cast("array<double>")
    each = x.mapInArrow(run, out).select(F.col("key").alias(key), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
