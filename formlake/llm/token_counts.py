"""Token counts of whole texts, by a public tokenizer file.

Texts go to Arrow functions that return lengths only; no id leaves a worker.
Texts of over ``SLICE`` characters are split at safe boundaries, where the
tokenizer can join nothing: at a blank between two other signs. Pieces are gathered
into slices of about ``SLICE`` characters, whatever the number of rows, and cut on into
parts that the tokenizer treats alone. Parts that the worker has not counted
before go to the library in batches of about ``CALL`` characters; lengths of
``HELD`` short parts at most are remembered. So neither the number nor the
length of texts decides how much a worker holds, but for one stretch without a
boundary, which only the library itself can cut.

Where a boundary is safe depends on the file: see ``counter``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from formlake.llm.tokens import _PLAIN, _WITHOUT_BLANKS

SLICE = 1 << 21
CALL = 1 << 20
HELD = 1_000_000
#: Longer parts are counted anew each time.
_SHORT = 64
_LONGEST = 1 << 12
_BLANKS = re.compile(r"[\t-\r ]+")
_BEFORE_DIGIT = re.compile(r"(?=[0-9])")
#: A blank between two ASCII signs: where blanks belong to tokens, it goes with the word behind it.
_INNER_BLANK = re.compile(r"(?<=[!-~]) (?=[!-~])")
_BEFORE_INNER_BLANK = re.compile(r"(?<=[!-~])(?= [!-~])")


class Counter:
    """``lengths(texts)``: the number of the library's tokens of each text.

    ``count`` asks the library; ``parts`` cuts a text where no token can cross;
    ``blank`` finds where a text may be cut in two, and what is dropped there.
    """

    def __init__(self, count: Callable[[list[str]], list[int]], parts: Callable[[str], list[str]], blank: re.Pattern | None):
        self.count, self.parts, self.blank = count, parts, blank
        self.known: dict[str, int] = {}

    def _ask(self, call: list[str]) -> None:
        if call:
            self.known.update(zip(call, self.count(call), strict=True))

    def _learn(self, parts: Iterable[str]) -> None:
        call, size = [], 0
        for p in parts:
            call.append(p)
            size += len(p)
            if size >= CALL:
                self._ask(call)
                call, size = [], 0
        self._ask(call)

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about ``SLICE`` characters, cut at safe blanks only."""
        start = 0
        while self.blank and len(text) - start > SLICE:
            found = self.blank.search(text, start + SLICE)
            if not found:
                break
            yield text[start : found.start()]
            start = found.end()
        yield text[start:] if start else text

    def _slice(self, pieces: list[str]) -> list[int]:
        cut = [self.parts(p) for p in pieces]
        unseen = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(unseen) > HELD:
            self.known.clear()
            unseen = set(chain.from_iterable(cut))
        self._learn(unseen)
        out = [sum(map(self.known.__getitem__, parts)) for parts in cut]
        for p in unseen:
            if len(p) > _SHORT:
                del self.known[p]
        return out

    def lengths(self, texts: Iterable[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, str]] = []
        size = 0

        def add() -> None:
            for (row, _), n in zip(held, self._slice([p for _, p in held]), strict=True):
                out[row] += n
            held.clear()

        for row, text in enumerate(texts):
            out.append(0)
            for p in self.pieces(text):
                held.append((row, p))
                size += len(p)
                if size >= SLICE:
                    add()
                    size = 0
        add()
        return out


def _parts_without_blanks(text: str) -> list[str]:
    """Texts of Latin letters by the pre-tokenizer's own pattern; others at ASCII blanks, and long stretches before ASCII digits, each of which is a token."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _WITHOUT_BLANKS.findall(text.lower())
    return [x for p in _BLANKS.split(text) for x in (_BEFORE_DIGIT.split(p) if len(p) > _LONGEST else [p]) if x]


def _json_counter(path: str) -> Counter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    drops_blanks = library.normalizer is not None
    count = lambda texts: list(map(len, library.encode_batch_fast(texts, add_special_tokens=False)))
    return Counter(count, _parts_without_blanks, _BLANKS) if drops_blanks else Counter(count, _BEFORE_INNER_BLANK.split, _BEFORE_INNER_BLANK)


def _model_counter(path: str) -> Counter:
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    blank = "▁"
    joins = any(blank in library.id_to_piece(k).lstrip(blank) for k in range(library.get_piece_size()))
    count = lambda texts: list(map(len, library.encode(texts, num_threads=1)))
    # The library puts a blank before each text, so one before a word goes.
    return Counter(count, lambda t: [t], None) if joins else Counter(count, _INNER_BLANK.split, _INNER_BLANK)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per file and Python worker: the tokenizers library for ``.json``, sentencepiece for ``.model``.

    Three kinds of boundaries: vocabularies with a normalizer drop blanks; byte-level
    ones without it take a single blank into the token behind it; a sentencepiece model
    puts a blank before each text, and is cut only if no piece of it holds a blank inside.
    """
    if path not in _COUNTERS:
        if not path.endswith((".json", ".model")):
            raise ValueError(f"no library for {path}: .json and .model files are read")
        _COUNTERS[path] = _json_counter(path) if path.endswith(".json") else _model_counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of each whole text, and whether they are more than ``limit``.

    Tokens are those of the library for the file, without begin and end tokens;
    special strings inside texts are treated as is the library's default. A null
    text is empty; rows without an id and repeated rows are counted like any
    other; an empty table gives none. Other columns are not read.
    """
    out = StructType([docs.schema["doc_id"]]).add("n_bytes", LongType()).add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(path).lengths
        for b in batches:
            texts = (x.as_py() or "" for x in b["text"])
            n_bytes = pc.fill_null(pc.binary_length(b["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], n_bytes, pa.array(lengths(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
