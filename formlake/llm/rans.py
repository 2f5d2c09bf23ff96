"""Token ids in a binary format, coded by a static range asymmetric numeral system.

Writing goes in three Spark steps: tokenise into a work table; count every id
of the whole corpus (at most one row per vocabulary entry reaches the driver);
deal the documents out by ranges of the id, and encode and write each in order,
in independent blocks against the shared frequency table.

The format is a folder with two Parquet tables. ``tables`` holds the frequency
table (one row). ``documents`` holds one row per document: ``part`` and
``offset`` (ids before the document in its part), the document's id and its
number of ids, and ``blocks``, an array of:

    magic 'RNS1' | u32 ids | u16 lanes | u16 steps between checkpoints |
    u32 words | u32 crc32 of the ids | u32 crc32 of what follows |
    u64 state per lane | checkpoints: u32 word offset, u64 state per lane |
    u32 words

Lane j codes the ids j, j + lanes, ...; the lanes share one stream of 32-bit
words. A checkpoint holds the decoder's position and states, so that decoding
may start there. Both checksums are verified on reading.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm.tokens import encoder
from formlake.llm.work import materialise, new_path

BLOCK = 1 << 16
LANE = 512
CHECK = 256
SCALE = 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIHHIII")
_U32, _U64 = np.uint64(32), np.uint64(SCALE)


def frequency_table(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Frequencies that sum to 2^SCALE; every id that occurs gets 1 at least."""
    total = 1 << SCALE
    freq = np.zeros(size, np.int64)
    if not len(ids):
        return freq.astype(np.uint32)
    share = counts / counts.sum() * (total - len(ids))
    freq[ids] = 1 + np.floor(share).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    freq[ids[order[: total - freq.sum()]]] += 1
    return freq.astype(np.uint32)


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lanes of blocks with ``sizes`` ids (none empty), the longest blocks first."""
    lanes = (sizes + LANE - 1) // LANE
    steps = (sizes + lanes - 1) // lanes
    block = np.repeat(np.arange(len(sizes)), lanes)
    first = np.concatenate(([0], np.cumsum(lanes)[:-1]))
    return lanes, steps, block, first, np.arange(len(block)) - first[block]


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray) -> list[bytes]:
    """Payloads of blocks of 1 to BLOCK ids each; lanes of all blocks advance together."""
    order = sorted(range(len(blocks)), key=lambda i: -_steps(len(blocks[i])))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    lanes, steps, block, first, lane = _layout(sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.concatenate([blocks[i] for i in order])
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    state = np.full(len(block), _LOW, np.uint64)
    stride, size, at0 = lanes[block], sizes[block], begin[block] + lane
    words: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    lane_steps = steps[block]
    for t in range(int(steps[0]) - 1, -1, -1):
        n = int(np.searchsorted(-lane_steps, -t, "left"))  # lanes of blocks with more than t steps
        on = np.flatnonzero(t * stride[:n] + lane[:n] < size[:n])
        sym = flat[at0[on] + t * stride[on]]
        f, x = f64[sym], state[on]
        big = x >= f << np.uint64(31 - SCALE + 32)
        out = on[big]
        words.append((x[big] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owner.append(block[out])
        x = np.where(big, x >> _U32, x)
        d = x // f
        state[on] = (d << _U64) + (x - d * f) + cum[sym]
        if t and t % CHECK == 0:
            marks.append((t, state[:n].copy()))
    own = np.concatenate(owner[::-1]) if owner else np.zeros(0, np.int64)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    by = np.argsort(own, kind="stable")
    stream, count = stream[by], np.bincount(own, minlength=len(sizes))
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    before: dict[int, np.ndarray] = {}
    seen = np.zeros(len(sizes), np.int64)
    for t, o in enumerate(owner[::-1]):  # words of a block before step t
        if t and t % CHECK == 0:
            before[t] = seen.copy()
        seen += np.bincount(o, minlength=len(sizes))
    result: list[bytes] = [b""] * len(blocks)
    marks.sort(key=lambda m: m[0])
    for k, i in enumerate(order):
        a, b = int(first[k]), int(first[k] + lanes[k])
        body = [state[a:b].tobytes()]
        for t, states in marks:
            if t < steps[k]:
                body.append(struct.pack("<I", int(before[t][k])) + states[a:b].tobytes())
        body.append(stream[start[k] : start[k] + count[k]].tobytes())
        rest = b"".join(body)
        ids = np.ascontiguousarray(blocks[i], "<u4").tobytes()
        result[i] = _HEAD.pack(b"RNS1", len(blocks[i]), int(lanes[k]), CHECK, int(count[k]), zlib.crc32(ids), zlib.crc32(rest)) + rest
    return result


def _steps(n: int) -> int:
    lanes = (n + LANE - 1) // LANE
    return (n + lanes - 1) // lanes


def decode_blocks(payloads: list[bytes], freq: np.ndarray, symbol: np.ndarray, checkpoint: int = 0) -> list[np.ndarray]:
    """Ids of each payload, from its ``checkpoint``-th checkpoint on (0: the start).

    ``symbol``: the id of each of the 2^SCALE slots. Raises ValueError where a
    checksum does not hold.
    """
    heads = []
    for p in payloads:
        head = _HEAD.unpack_from(p)
        if head[0] != b"RNS1" or zlib.crc32(memoryview(p)[_HEAD.size :]) != head[6]:
            raise ValueError("damaged block")
        heads.append(head)
    order = sorted(range(len(payloads)), key=lambda i: -_steps(heads[i][1]))
    sizes = np.array([heads[i][1] for i in order], np.int64)
    lanes, steps, block, first, lane = _layout(sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    states, streams, skip = [], [], np.zeros(len(order), np.int64)
    for k, i in enumerate(order):
        n, marks = int(lanes[k]), (int(steps[k]) - 1) // heads[i][3]
        if checkpoint > marks:
            raise ValueError("no such checkpoint")
        at = _HEAD.size + (checkpoint and 8 * n + (checkpoint - 1) * (4 + 8 * n) + 4)
        states.append(np.frombuffer(payloads[i], "<u8", n, at))
        skip[k] = struct.unpack_from("<I", payloads[i], at - 4)[0] if checkpoint else 0
        streams.append(np.frombuffer(payloads[i], "<u4", heads[i][4], _HEAD.size + 8 * n + marks * (4 + 8 * n)))
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    next_word = np.concatenate(([0], np.cumsum([len(x) for x in streams])[:-1])) + skip
    state = np.concatenate(states).astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    flat = np.zeros(int(sizes.sum()), np.uint32)
    stride, size, at0, lane_steps = lanes[block], sizes[block], begin[block] + lane, steps[block]
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(checkpoint * CHECK, int(steps[0])):
        n = int(np.searchsorted(-lane_steps, -t, "left"))
        on = np.flatnonzero(t * stride[:n] + lane[:n] < size[:n])
        x = state[on]
        slot = x & mask
        sym = symbol[slot]
        flat[at0[on] + t * stride[on]] = sym
        x = f64[sym] * (x >> _U64) + slot - cum[sym]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            own = block[on[low]]
            fresh = np.concatenate(([True], own[1:] != own[:-1]))
            starts = np.flatnonzero(fresh)
            rank = np.arange(len(own)) - starts[np.cumsum(fresh) - 1]
            x[low] = (x[low] << _U32) | stream[next_word[own] + rank]
            next_word[own[starts]] += np.diff(np.concatenate((starts, [len(own)])))
        state[on] = x
    result: list[np.ndarray] = [flat[:0]] * len(payloads)
    for k, i in enumerate(order):
        ids = flat[begin[k] + checkpoint * CHECK * lanes[k] : begin[k] + sizes[k]]
        if not checkpoint and zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][5]:
            raise ValueError("ids do not match their checksum")
        result[i] = ids
    return result


def _tokenised(docs: DataFrame, text: str, id_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids as 16-bit integers where the vocabulary allows, else 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = _kind(enc.vocabulary, end_id)
        for b in batches:
            for part in _slices(b):
                ids = [x.astype(kind).tobytes() for x in enc.encode_all(part.column(1).to_pylist(), end_id)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {id_kind}, ids binary")


def _kind(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _counts(tokens: DataFrame, kind: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for some in _slices(b, 4096):  # counted together: a count costs as much as the vocabulary is large
                n += np.bincount(np.frombuffer(b"".join(some.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", id_col: str = "doc_id", parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write the format to ``path``.

    Documents lie in ascending order of the id (null ids first); rows that
    repeat one, of a hash of their ids, so that a rerun gives the same file. Null
    and empty texts are the end id alone. An empty table gives a folder without
    documents. ``tokenizer``: path of a tokenizers file, readable on executors.
    ``parts``: number of files, by default spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    vocabulary = max(encoder(tokenizer).vocabulary, end_id + 1)
    kind = _kind(vocabulary, end_id)
    tokens = materialise(_tokenised(docs, text, id_col, tokenizer, end_id).withColumn("tie", F.xxhash64("ids")), "tokens")
    counted = _counts(tokens, kind, vocabulary).toPandas()  # a row per vocabulary entry at most
    freq = frequency_table(counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.float64), vocabulary)
    spark.createDataFrame([(SCALE, freq.tobytes())], "scale int, frequencies binary").write.parquet(f"{path}/tables")
    shared = spark.sparkContext.broadcast(freq)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = 0  # a task holds one part of the file
        for b in batches:
            sizes = np.cumsum([len(x) for x in b.column(1).to_pylist()]) // np.dtype(kind).itemsize
            for some in _cuts(b, sizes):
                ids = [np.frombuffer(x, kind) for x in some.column(1).to_pylist()]
                payload = iter(encode_blocks([x[at : at + BLOCK] for x in ids for at in range(0, len(x), BLOCK)], shared.value))
                blocks = [[next(payload) for _ in range(0, len(x), BLOCK)] for x in ids]
                ends = offset + np.cumsum([len(x) for x in ids])
                starts = np.concatenate(([offset], ends[:-1]))
                offset = int(ends[-1])
                columns = [some.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(blocks, pa.list_(pa.binary())), some.column(2), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "blocks", "part", "offset"])

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    dealt = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "ids", F.spark_partition_id().alias("part"))
    id_kind = tokens.schema["doc_id"].dataType.simpleString()
    out = dealt.mapInArrow(encode, f"doc_id {id_kind}, n_ids long, blocks array<binary>, part int, offset long")
    out.write.option("compression", "uncompressed").parquet(f"{path}/documents")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): one row per document, its ids as little-endian unsigned 32-bit integers.

    ``start``: ids of all documents before it in the file. Documents, and the
    blocks of each, are decoded independently of one another; a damaged one
    raises an error.
    """
    freq = np.frombuffer(spark.read.parquet(f"{path}/tables").first()["frequencies"], np.uint32)
    docs = spark.read.parquet(f"{path}/documents")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    totals = sorted(docs.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per file of the format
    bases = dict(zip([t[0] for t in totals], np.cumsum([0] + [t[1] for t in totals]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((freq, bases))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bases = shared.value
        symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        for b in batches:
            for some in _cuts(b, np.cumsum(b.column("n_ids").to_numpy())):
                blocks = some.column("blocks").to_pylist()
                decoded = iter(decode_blocks([x for doc in blocks for x in doc], freq, symbol))
                ids = [b"".join(next(decoded).astype("<u4").tobytes() for _ in doc) for doc in blocks]
                start = [bases[p] + o for p, o in zip(some.column("part").to_pylist(), some.column("offset").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return docs.select("doc_id", "n_ids", "blocks", "part", "offset").mapInArrow(decode, f"doc_id {id_kind}, start long, ids binary")


def _cuts(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` ids, one row at least; ``sizes``: ids up to and with each row."""
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def new_token_file(spark: SparkSession) -> str:
    return new_path(spark, "token-file")

