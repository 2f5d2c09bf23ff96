"""The closest pairs of vectors that share a key: blocks of rows meet pairwise, and only what may be among the closest leaves a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows of a block, about
TILE = 512
EXACT = 1 << 14  # pairs whose distances are taken at once
WINDOW = 1e-5  # distances nearer to each other may swap places when rounded


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of doubles and, below them, whether a component is there: 2 x n x width; what is null or beyond a vector's end is not."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    values, rows = vectors.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((2, len(sizes), int(sizes.max(initial=0))))
    out[0, rows, places] = values.fill_null(0).to_numpy(zero_copy_only=False)
    out[1, rows, places] = values.is_valid().to_numpy(zero_copy_only=False)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, added up component by component in order; null (here -1) without a common component."""
    total, shared = np.zeros(x.shape[1]), np.zeros(x.shape[1], dtype=bool)
    for k in range(x.shape[2]):
        both = (x[1, :, k] * y[1, :, k]) > 0
        gap = x[0, :, k] - y[0, :, k]
        total += np.where(both, gap * gap, 0.0)
        shared |= both
    return np.where(shared, np.sqrt(total), -1.0)


def _squared(x: np.ndarray, y: np.ndarray, whole: bool) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``, but for rounding."""
    cross = x[0] @ y[0].T
    if whole:
        return (x[0] ** 2).sum(axis=1)[:, None] + (y[0] ** 2).sum(axis=1)[None, :] - 2 * cross
    return (x[0] ** 2) @ y[1].T + x[1] @ (y[0] ** 2).T - 2 * cross


class _Closest:
    """Pairs that fewer than ``k`` others precede, for certain, by (distance, a, b)."""

    def __init__(self, k: int):
        self.k, self.pairs, self.bound = k, [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)], np.inf

    def add(self, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        d, a, b = (np.concatenate(p) for p in zip(self.pairs, (d, a, b), strict=True))
        rank = np.where(d < 0, 3, np.where(np.isnan(d), 2, 0))  # not a number behind all, null behind these
        by = np.lexsort((b, a, np.where(rank > 0, 0, d), rank))
        d, a, b, rank = d[by], a[by], b[by], rank[by]
        fresh = np.r_[True, (rank[1:] != rank[:-1]) | ((rank[1:] == 0) & (d[1:] != d[:-1]))][: len(d)]
        keep = np.arange(len(d)) - np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0)) < self.k
        if len(d) >= self.k:
            self.bound = d[self.k - 1] + WINDOW if rank[self.k - 1] == 0 else np.inf
            keep &= (rank <= rank[self.k - 1]) & ((rank > 0) | ~(d > self.bound))
        self.pairs = [d[keep], a[keep], b[keep]]


def _of_blocks(ids: np.ndarray, own: np.ndarray, m: np.ndarray, i: int, j: int, k: int) -> _Closest:
    best, whole = _Closest(k), bool(m[1].all())
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    largest = (m[0] ** 2).sum(axis=1).max(initial=0)
    slack = 1e-12 * largest
    for s in range(0, len(left), TILE):
        rows = left[s : s + TILE]
        with np.errstate(invalid="ignore", over="ignore"):
            near = _squared(m[:, rows], m[:, right], whole)
        meets = ids[rows][:, None] < ids[right][None, :] if i == j else ids[rows][:, None] != ids[right][None, :]
        if np.isfinite(best.bound):
            p, q = np.nonzero(meets & ~(near > best.bound**2 + slack))
        else:
            p, q = np.nonzero(meets)
        by = np.argsort(near[p, q], kind="stable")
        p, q = p[by], q[by]
        for t in range(0, len(p), EXACT):
            u, v = p[t : t + EXACT], q[t : t + EXACT]
            if np.isfinite(best.bound):
                open_ = ~(near[u, v] > best.bound**2 + slack)
                u, v = u[open_], v[open_]
            if len(u):
                x, y = rows[u], right[v]
                with np.errstate(invalid="ignore", over="ignore"):
                    d = _distances(m[:, x], m[:, y])
                best.add(d, np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]))
    return best


def candidates(rows: DataFrame, key: str, id_col: str, vector: str, k: int) -> DataFrame:
    """(a, b, d): pairs of rows of one key, a < b by id, with their Euclidean distance, among them the ``k`` closest of all by (d rounded to six places, a, b).

    Rows are dealt into blocks of about BLOCK, and every two blocks of a key meet in one
    group, which gives back little more than ``k`` pairs: those that fewer than ``k`` of its
    own pairs precede, equal distances by (a, b). Null components and those beyond the shorter
    vector's end count nothing; without a common component the distance is null. Rows without
    key or id meet nobody; ids are long. The work grows with the square of a key's rows, memory does not.
    """
    v = rows.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and id is not null")
    blocks = v.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).select(F.col("key").alias("bk"), "blocks")
    own = v.join(blocks, F.col("key") == F.col("bk")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")

    def closest(group: pa.Table) -> pa.Table:
        column = {c: group[c].combine_chunks() for c in group.column_names}
        plain = {c: column[c].to_numpy() for c in ("id", "own")}
        d, a, b = _of_blocks(plain["id"], plain["own"], _matrix(column["v"]), column["i"][0].as_py(), column["j"][0].as_py(), k).pairs
        return pa.table({"a": a, "b": b, "d": pa.array(d, mask=d < 0)})

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(closest, "a long, b long, d double")
