"""Quality classifier: hashed word n-gram logistic regression by FTRL-proximal updates.

A text's features are its words and word pairs, hashed into 2^BITS slots, as
shares of the whole text. Words are runs of letters or digits, with each run of
other signs a word of its own, lower-cased; a word in capitals also counts as
the class "capitals", a word equal to its predecessor as the class "again" and
any letter word as the class "word", so what is learned holds for unseen words.

Training takes a bounded sample of labelled rows (``sample``, by seeded hash),
featurised where the rows lie; one task makes the sequential FTRL passes over
the sparse vectors. The weights (2^BITS floats, 1 MB) go to all tasks, which
score texts as sparse dot products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.work import materialise

BITS = 18
SAMPLE = 8000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_WORD, _CAPITALS, _AGAIN, _SIGN = 1, 2, 3, 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """Token -> (hash, class); starts anew at ``limit`` tokens."""

    limit = 300_000

    def __missing__(self, token: str) -> int:
        import xxhash

        kind = (_CAPITALS if len(token) > 1 and token.isupper() else _WORD) if token[0].isalnum() else _SIGN
        made = (xxhash.xxh32_intdigest(token.lower(), 9) << 3) | kind
        if len(self) >= self.limit:
            self.clear()
        self[token] = made
        return made


_HASHES = _Hashes()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots (int32) and values (float32) of one text; slot 0 is the bias."""
    packed = np.fromiter(map(_HASHES.__getitem__, _TOKEN.findall(text)), np.uint64)
    n = len(packed)
    if not n:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    word, kind = packed >> np.uint64(3), (packed & np.uint64(7)).copy()
    kind[1:][word[1:] == word[:-1]] = _AGAIN
    grams = [word * _MIX[0], kind * _MIX[1]]
    if n > 1:
        grams += [(word[:-1] * _MIX[0] + word[1:]) * _MIX[1], (kind[:-1] * np.uint64(8) + kind[1:] + np.uint64(64)) * _MIX[1]]
    slots = np.concatenate([g >> np.uint64(64 - BITS) for g in grams])
    slot, count = np.unique(slots, return_counts=True)
    keep = slot > 0
    return np.concatenate(([0], slot[keep])).astype(np.int32), np.concatenate(([1.0], np.sqrt(count[keep] / n))).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 0, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal weights (float32, 2^BITS) from (slots, values, label), in the order given.

    ``passes`` 0: as many as make about 24,000 updates, 3 at least and 20 at most.
    """
    passes = passes or max(3, min(20, 24_000 // max(1, len(rows))))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(passes):
        for slot, value, label in rows:
            zi, ni = z[slot], n[slot]
            w = weights(zi, ni)
            g = (sigmoid(float(w @ value)) - label) * value
            more = ni + g * g
            z[slot] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[slot] = more
    return weights(z, n).astype(np.float32)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 9) -> bytes:
    """Weights as bytes, from ``sample`` labelled rows at most that are outside fold 0.

    Rows with a null id or label teach nothing; of labels that repeat an id the
    smallest counts, and of rows that repeat an id the text with the smallest
    hash: no task gets more than ``sample`` rows. Without labelled rows the
    weights are zero.
    """
    chosen = labels.filter((fold(id_col) != 0) & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).cast("double").alias("_label"))
    chosen = chosen.withColumn("_order", F.xxhash64(F.lit(seed), id_col)).orderBy("_order", id_col).limit(sample)
    chosen = chosen.select(F.col(id_col).alias("_id"), "_label", "_order")
    rows = docs.select(id_col, F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))  # ``sample`` rows at most
    rows = rows.groupBy("_order", "_id", "_label").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(x or "") for x in b.column(0).to_pylist()]
            both = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*both, b.column(1), b.column(2)], names=["slots", "vals", "label", "ord"])

    vectors = rows.select("t", "_label", "_order").mapInArrow(featurise, "slots binary, vals binary, label double, ord long")
    vectors = materialise(vectors, "features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            slots, values, label, order = (b.column(k).to_pylist() for k in range(4))
            rows += [(o, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for o, s, v, y in zip(order, slots, values, label, strict=True)]
        rows.sort(key=lambda r: (r[0], len(r[1])))
        yield pa.RecordBatch.from_arrays([pa.array([train([r[1:] for r in rows]).tobytes()], pa.binary())], names=["w"])

    return bytes(vectors.coalesce(1).mapInArrow(learn, "w binary").first()["w"])


def score(docs: DataFrame, weights: bytes, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row: the chance of label 1, from the whole text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float32)
        for b in batches:
            found = [features(x or "") for x in b.column(1).to_pylist()]
            p = [sigmoid(float(w[slot] @ value)) for slot, value in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    ``held_out``: the row lies in fold 0 and taught nothing (a null id too).
    Null and empty texts get the score of the bias. Repeated rows are scored
    each; an empty table gives an empty result; columns other than the two
    named are never read.
    """
    weights = fit(docs, labels, label, text, id_col, **how)
    held = F.coalesce(fold(id_col) == 0, F.lit(True))
    return score(docs, weights, text, id_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
