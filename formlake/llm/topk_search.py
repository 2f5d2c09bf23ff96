"""Exact top-k search by inner product, with block-at-a-time pruning.

Components become integers. Vectors are ordered by their nearest pivot, so that
neighbours in that order are alike, and cut into ranges: blocks of ``BLOCK``
vectors, which hold a forward index (their matrix) and each component's largest
and smallest value. A block's bound for a query is the sum, over components, of
the larger of query times maximum and query times minimum. Blocks are visited
in descending order of the bound, until it falls below the query's k-th best
score; no vector of the blocks left can enter the result, so it is exact.

A shard of consecutive blocks and chunks of the query set meet in one task: the
shard is held, query chunks stream past it. Every query starts with the k-th
best score over a bounded sample of the vectors, a valid lower bound, so most
blocks are never opened. A shard has the same kind of bound as a block, and a
query is sent only to shards whose bound reaches its floor. Pivots and sample
only steer the pruning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.llm.work import materialise

BLOCK = 256
CHUNK = 1024
SAMPLE = 4096
PIVOTS = 64
#: Components of all shard bounds that one task may hold (twice 8 bytes each); beyond it queries go to every shard.
MOST_BOUNDS = 4_000_000


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double; null where the vector, or a component, is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array, width: int, dtype: np.dtype) -> np.ndarray:
    """Rows of ``dtype`` integers, short ones filled up with zeros."""
    values, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly, in 64 bits; a sum beyond them becomes their nearest end.

    Doubles where every partial sum fits. 64-bit integers wrap around, so their
    sum is right wherever the true one fits; pairs that may not fit are summed
    one by one in Python's integers.
    """
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (x @ y.T).astype(np.int64)
    out = a.astype(np.int64) @ b.astype(np.int64).T
    if most >= 1 << 62:
        ends = np.iinfo(np.int64)
        for i, j in np.argwhere(np.abs(x) @ np.abs(y).T >= float(1 << 62)):
            out[i, j] = min(max(sum(int(p) * int(q) for p, q in zip(a[i], b[j], strict=True)), ends.min), ends.max)
    return out


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and each range of vectors, the most that a vector within its largest and smallest components can score."""
    return _product(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([high, low]))


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Centres of the sample by a few rounds of Lloyd's algorithm, from evenly spaced rows."""
    x = sample.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
    for _ in range(5):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count, total / np.maximum(count, 1), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


class Shard:
    """Blocks held by a task; ``search`` answers a chunk of queries over them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        cut = range(0, len(rows), BLOCK)
        self.blocks = [(rows[a : a + BLOCK], ids[a : a + BLOCK], vectors[a : a + BLOCK]) for a in cut]
        self.high = np.array([b[2].max(axis=0) for b in self.blocks])
        self.low = np.array([b[2].min(axis=0) for b in self.blocks])
        self.opened = self.possible = 0

    def search(self, rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, score, id, row) of all that may be among a query's k best; ``floor``: scores below are of no use."""
        bound = _bounds(queries, self.high, self.low)
        order = np.argsort(~bound, axis=1, kind="stable")
        floor = floor.copy()
        best = [np.zeros(0, np.int64) for _ in range(4)]
        self.possible += bound.size
        for step in range(len(self.blocks)):
            block = order[:, step]
            live = np.flatnonzero(bound[np.arange(len(queries)), block] >= floor)
            if not len(live):
                break
            self.opened += len(live)
            found = [best]
            for b in np.unique(block[live]):
                own = live[block[live] == b]
                r, i, v = self.blocks[b]
                score = _product(queries[own], v)
                q, c = np.nonzero((score >= floor[own][:, None]) & (rows[own][:, None] != r[None, :]))
                found.append([own[q], score[q, c], i[c], r[c]])
            best = [np.concatenate(x) for x in zip(*found, strict=True)]
            by = np.lexsort((best[3], best[2], ~best[1], best[0]))
            best = [x[by] for x in best]
            first = np.searchsorted(best[0], best[0])
            keep = np.arange(len(by)) - first < k
            best, first = [x[keep] for x in best], first[keep]
            count = np.bincount(best[0], minlength=len(queries))
            full = np.flatnonzero(count >= k)
            kth = best[1][np.searchsorted(best[0], full, "right") - 1]
            floor[full] = np.maximum(floor[full], kth)
        return tuple(best)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", id_col: str = "vec_id", scale: int = 64) -> DataFrame:
    """(query_id, rank int, vec_id, score long): the k best of each query row, ties to the smaller id.

    Queries: rows where ``is_query`` holds; candidates: all rows but the
    query's own. Vectors that are null or hold null or non-finite components
    take no part; scaled components and scores beyond 64 bits count as the
    nearest end of their range; shorter vectors count as filled up with zeros; a null id
    makes no query and is no candidate. Rows that repeat an id are queries and
    candidates each. With fewer than k candidates all are returned; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(rows.filter("id is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, width, top, bottom = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, dtype = max(1, width), np.dtype(np.int32 if max(top or 0, -(bottom or 0)) < 1 << 31 else np.int64)
    some = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").toArrow().combine_chunks()
    sample = _matrix(some.column("v").combine_chunks(), width, dtype)
    steer = spark.sparkContext.broadcast((_pivots(sample), sample, some.column("row").to_numpy()))
    per_shard = max(2048, min(65_536, n // 64))
    shards = -(-n // per_shard)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), width, dtype)
            data = pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data, b.column(2), b.column(3), pa.array(_nearest(m, steer.value[0]), pa.int32())], names=["id", "v", "q", "row", "pivot"])

    placed = materialise(rows.select("id", "v", "q", "row").mapInArrow(near, "id long, v binary, q boolean, row long, pivot int"), "placed")
    ranged = placed.repartitionByRange(shards, "pivot", "row").sortWithinPartitions("pivot", "row").select("row", "id", "v")

    def pack(limit: int, kind: int, with_floor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seq, held = TaskContext.get().partitionId(), 0, []

            def flush() -> pa.RecordBatch:
                nonlocal seq, held
                some, held = held, []
                r, i = (np.array([x[c] for x in some], np.int64) for c in (0, 1))
                m = np.frombuffer(b"".join(x[2] for x in some), dtype).reshape(len(some), width)
                floor = _floors(r, m, steer.value[1], steer.value[2], k) if with_floor else r[:0]
                seq += 1
                cells = [[part], [kind], [seq], *([x.tobytes()] for x in (r, i, m, floor))]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=names)

            for b in batches:
                for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(x)
                    if len(held) == limit:
                        yield flush()
            if held:
                yield flush()

        return run

    names = ["part", "kind", "seq", "r", "i", "m", "f"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    schema = "part int, kind int, seq int, r binary, i binary, m binary, f binary"
    indexed = materialise(ranged.mapInArrow(pack(8 * BLOCK, 0, False), schema), "index").withColumn("shard", F.col("part"))
    asked = materialise(placed.filter("q").select("row", "id", "v").mapInArrow(pack(CHUNK, 1, True), schema), "queries")
    last = indexed.agg(F.max("part")).first()[0]
    if (last + 1) * width <= MOST_BOUNDS:
        sent = asked.mapInArrow(_router(spark, indexed, width, dtype), f"{schema}, shard int")
    else:
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    meeting = indexed.unionByName(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "part", "seq")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        shard, number = None, None
        for b in batches:
            for at in range(b.num_rows):
                own, kind, r, i, m, f = (b.column(c)[at].as_py() for c in ("shard", "kind", "r", "i", "m", "f"))
                if own != number:
                    number, held, shard = own, [], None
                r, i, m, f = np.frombuffer(r, np.int64), np.frombuffer(i, np.int64), np.frombuffer(m, dtype).reshape(-1, width), np.frombuffer(f, np.int64)
                if kind == 0:
                    held.append([r, i, m])
                    continue
                if not held:
                    continue
                shard = shard or Shard(*(np.concatenate(x) for x in zip(*held, strict=True)))
                q, score, ids, rows = shard.search(r, m, f, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r[q], i[q], ids, rows, score)], names=["qrow", "query_id", "vec_id", "row", "score"])

    found = meeting.select("shard", "kind", "r", "i", "m", "f").mapInArrow(search, "qrow long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _router(spark: SparkSession, indexed: DataFrame, width: int, dtype: np.dtype):
    """A function that sends each query of a chunk to the shards whose bound reaches its floor."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(m, dtype).reshape(-1, width)
                cells = [[part] * width, range(width), m.max(axis=0), m.min(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "c", "high", "low"])

    spans = indexed.select("part", "m").mapInArrow(extremes, "part int, c int, high long, low long").groupBy("part", "c").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    found = spans.orderBy("part", "c").toArrow()  # at most MOST_BOUNDS rows
    parts = found.column("part").to_numpy()[::width]
    held = spark.sparkContext.broadcast((parts, *(found.column(k).to_numpy().reshape(-1, width) for k in ("high", "low"))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, high, low = held.value
        for b in batches:
            for row in b.to_pylist():
                r, i, f = (np.frombuffer(row[k], np.int64) for k in "rif")
                m = np.frombuffer(row["m"], dtype).reshape(-1, width)
                live = _bounds(m, high, low) >= f[:, None]
                for s in np.flatnonzero(live.any(axis=0)):
                    own = live[:, s]
                    cells = [[x] for x in (row["part"], row["kind"], row["seq"], r[own].tobytes(), i[own].tobytes(), m[own].tobytes(), f[own].tobytes(), int(parts[s]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (*b.schema.types, pa.int32()), strict=True)], names=[*b.schema.names, "shard"])

    return route


def _floors(rows: np.ndarray, queries: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query over the sample, its own row left out: a lower bound of its k-th best of all."""
    low = np.iinfo(np.int64).min
    score = _product(queries, sample)
    score[rows[:, None] == sample_rows[None, :]] = low
    if score.shape[1] < k:
        return np.full(len(rows), low)
    return np.partition(score, -k, axis=1)[:, -k]
