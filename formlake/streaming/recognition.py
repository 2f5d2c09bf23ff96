"""Recognising pages as they arrive: a stricter second try, dead letters, a run log, and restarts that lose and double nothing.

The engine is loaded once per task and asked page by page, because whether it
is asked again depends on what it said. It runs as a table function joined
laterally to its pages. A batch of the stream is written once, under its number,
by overwriting: a batch that is run again after a failure replaces what it
had written before.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_id long, page string"
RESULT = "values map<string,string>, raw string, attempts int, seconds double, n_tokens long, extra_keys string, error string"

#: Reads a page; the flag asks for the stricter wording. Returns the text and the number of input tokens.
Reader = Callable[[Any, bool], tuple[str, int]]

_BARE = re.compile(r'(:\s*)(?!null\b|true\b|false\b)([^\s"\[\]{},][^,}\]\n"]*?)(?=\s*[,}])')


def answer_fields(raw: str, fields: Sequence[str]) -> tuple[dict[str, str], list[str]]:
    """Values of ``fields`` in a model's answer, as text ('' where absent, null or an object; arrays joined with blanks), and the keys beyond them; ValueError if there is no object."""
    start, end = raw.find("{"), raw.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no object in the answer")
    body = raw[start : end + 1]
    try:
        found = json.loads(body, parse_int=str, parse_float=str)
    except json.JSONDecodeError:
        found = json.loads(_BARE.sub(lambda m: m[1] + json.dumps(m[2]), body), parse_int=str, parse_float=str)

    def text(v: Any) -> str:
        if v is None or isinstance(v, dict):
            return ""
        return (" ".join(map(str, v)) if isinstance(v, list) else str(v)).strip()

    return {f: text(found.get(f)) for f in fields}, sorted(set(found) - set(fields))


def recognised(pages: DataFrame, engine: Callable[[], Reader], fields: Sequence[str], retries: int = 1) -> DataFrame:
    """``pages`` (doc_id, page, ...) with ``values``, ``raw``, ``attempts``, ``seconds``, ``n_tokens``, ``extra_keys`` and ``error``: a row for every page.

    ``engine()`` loads a reader, once per task. An answer that can't be read, or
    an engine that raises, is tried ``retries`` times more with the stricter wording; then
    the page has '' in all fields and an error. A failing page never stops the others.
    """
    names = list(fields)

    @F.udtf(returnType=RESULT)
    class Recognise:
        def __init__(self) -> None:
            self.read: Reader | None = None

        def eval(self, page: Any) -> Iterator[tuple]:
            self.read = self.read or engine()
            began = time.perf_counter()
            raw = n_tokens = error = None
            values, extra = dict.fromkeys(names, ""), []
            for attempt in range(retries + 1):
                try:
                    raw, n_tokens = self.read(page, attempt > 0)
                    values, extra = answer_fields(raw or "", names)
                    error = None
                    break
                except Exception as e:  # whatever an engine raises is the page's own error
                    error = f"{type(e).__name__}: {e}"
            yield values, raw, attempt + 1, round(time.perf_counter() - began, 3), n_tokens, ",".join(extra), error

    return pages.lateralJoin(Recognise(F.col("page").outer()))


def run_log(results: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, seconds, n_tokens, attempts, parsed, n_empty, extra_keys, error) of every page, and ``more`` columns."""
    empty = F.size(F.map_filter("values", lambda _, v: v == ""))
    return results.select("doc_id", "seconds", "n_tokens", "attempts", F.col("error").isNull().alias("parsed"), empty.alias("n_empty"), "extra_keys", "error", *more)


def recognise_new_pages(
    spark: SparkSession, landing: str, output: str, checkpoint: str, engine: Callable[[], Reader], fields: Sequence[str], retries: int = 1, files: int | None = None, written: Callable[[int], None] | None = None
) -> dict[str, int]:
    """Recognise the pages (JSON lines of ``PAGES``) that arrived in ``landing`` since the last call; returns the pages and failures of this call.

    Under ``output`` each batch has its folders: ``results/batch=<n>`` with every page, and
    ``dead_letters/batch=<n>`` (doc_id, error, raw) with those that failed, drawn from the results as
    written, so that a page is in both or in none. ``checkpoint`` and ``output`` belong together: the
    batch numbers come from the one and name the folders of the other. ``files`` bounds the files
    of a batch; ``written`` is called with the number of a batch before it counts as done.
    """
    total = {"pages": 0, "failed": 0}

    def batch(rows: DataFrame, number: int) -> None:
        seen = Observation()
        done = recognised(rows, engine, fields, retries).observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        path = f"{output}/results/batch={number}"
        done.write.mode("overwrite").parquet(path)
        letters = rows.sparkSession.read.schema(done.schema).parquet(path).filter("error is not null").select("doc_id", "error", "raw")
        letters.write.mode("overwrite").parquet(f"{output}/dead_letters/batch={number}")
        if written:
            written(number)
        for k in total:
            total[k] += seen.get[k]

    source = spark.readStream.schema(PAGES)
    source = source.option("maxFilesPerTrigger", files) if files else source
    query = source.json(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return total


def results(spark: SparkSession, output: str) -> DataFrame:
    """All pages recognised so far."""
    return spark.read.parquet(f"{output}/results")
