"""Packing token sequences into fixed windows, with bounded space per partition.

Each partition keeps at most ``open_windows`` windows open. A document's full
windows leave at once; its rest goes into the open window that it fills best.
Where none has room, the fullest window is topped up with the head of the rest
and emitted. At the end of a partition its open windows are merged, fullest
first, so that less than one window of ids is left over. Those remainders
(a window per partition at most) are merged in the same way, ``FAN_IN``
partitions to a task, until one is left; it is cut into sequences whose lengths
are powers of two, so that nothing is padded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formlake.llm.tokens import encoder
from formlake.llm.work import materialise

WINDOW = 2048
FAN_IN = 1024
_SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, part int"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]

#: A piece: document, place of its first id there, its ids, ids of the document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Packs pieces one after another; ``emit`` gets each closed window's pieces."""

    def __init__(self, window: int, open_windows: int, emit: Callable[[list[Piece]], None]):
        self.window, self.limit, self.emit = window, open_windows, emit
        self.open: list[tuple[int, int]] = []  # (fill, key) in ascending order
        self.pieces: dict[int, list[Piece]] = {}
        self.next = 0

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        whole = len(ids) // 4 // self.window * self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + self.window)], total)])
        start, ids = start + whole, ids[4 * whole :]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.open, (self.window - n + 1, -1)) - 1
            if at >= 0 and (len(self.open) >= self.limit or self.open[at][0] + n == self.window):
                self._put(at, (doc, start, ids, total))
                return
            if len(self.open) < self.limit:
                key, self.next = self.next, self.next + 1
                self.pieces[key] = [(doc, start, ids, total)]
                insort(self.open, (n, key))
                return
            room = self.window - self.open[-1][0]
            self._put(len(self.open) - 1, (doc, start, ids[: 4 * room], total))
            start, ids = start + room, ids[4 * room :]

    def _put(self, at: int, piece: Piece) -> None:
        fill, key = self.open.pop(at)
        self.pieces[key].append(piece)
        fill += len(piece[2]) // 4
        if fill == self.window:
            self.emit(self.pieces.pop(key))
        else:
            insort(self.open, (fill, key))

    def merge(self) -> list[Piece]:
        """Close all windows, fullest first; what fills no window comes back."""
        rest = [p for _, key in reversed(self.open) for p in self.pieces[key]]
        self.open, self.pieces = [], {}
        last = Packer(self.window, 1, self.emit)
        for p in rest:
            last.add(p)
        return [p for x in last.pieces.values() for p in x]


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cut the last pieces into windows whose lengths are powers of two, longest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    while left:
        room = size = 1 << (left.bit_length() - 1)
        window: list[Piece] = []
        while room:
            doc, start, ids, total = pieces[0]
            n = min(room, len(ids) // 4)
            window.append((doc, start, ids[: 4 * n], total))
            pieces[0] = (doc, start + n, ids[4 * n :], total)
            if n == len(ids) // 4:
                pieces = pieces[1:]
            room -= n
        left -= size
        yield window


def _rows(source: Iterator[Piece], window: int, open_windows: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack one partition; closed windows get ids unique to level and partition, remainders a null one."""
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    made = 0

    def emit(pieces: list[Piece]) -> None:
        nonlocal made
        offset = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, ids, total, (level << 56) | (part << 32) | made, offset, part))
            offset += len(ids) // 4
        made += 1

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)
        rows.clear()
        return out

    packer = Packer(window, open_windows, emit)
    for piece in source:
        packer.add(piece)
        if len(rows) >= 1000:
            yield batch()
    rest = packer.merge()
    if last:
        for pieces in _powers(rest):
            emit(pieces)
    else:
        rows.extend((*p, None, k, part) for k, p in enumerate(rest))
    yield batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, open_windows: int = 64) -> DataFrame:
    """Pack every whole text, each followed by ``end_id``.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids (little-endian unsigned 32-bit integers), doc_tokens (ids of the
    document), sequence_id, offset (ids before it in its sequence; gapless from
    0). Each id lies in one piece. Every sequence holds ``window`` ids but for
    the last few, which hold powers of two. Null and empty texts are the end id
    alone; rows that repeat an id are packed each; a null id stays null; an
    empty table gives an empty result. ``window`` must be positive.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")

        def pieces() -> Iterator[Piece]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    some = b.slice(at, 1000)
                    for doc, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                        ids = enc.encode(t or "") + end
                        yield doc, 0, ids, len(ids) // 4

        return _rows(pieces(), window, open_windows, 0, False)

    def merging(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = (tuple(r.values()) for b in batches for r in b.to_pylist())
            return _rows(pieces, window, open_windows, level, last)

        return run

    level = 0
    out = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string")).mapInArrow(first, _SCHEMA)
    out = materialise(out, "packed")
    done = out.filter("sequence_id is not null")
    while True:
        rest = out.filter("sequence_id is null")
        parts = (rest.agg(F.max("part")).first()[0] or 0) + 1
        level, tasks = level + 1, -(-parts // FAN_IN)
        dealt = rest.withColumn("task", (F.col("part") / FAN_IN).cast("int")).repartitionById(tasks, "task")
        dealt = dealt.sortWithinPartitions("part", "offset").select("doc_id", "start", "ids", "doc_tokens")
        out = materialise(dealt.mapInArrow(merging(level, tasks == 1), _SCHEMA), f"packed{level}")
        done = done.unionByName(out.filter("sequence_id is not null"))
        if tasks == 1:
            break
    length = (F.octet_length("ids") / 4).cast("long")
    return done.select(F.col("doc_id").alias(id_col), "start", length.alias("length"), "ids", "doc_tokens", "sequence_id", "offset")

