"""Incremental ingestion: new raw page texts are parsed once, then the stream stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from formlake.operators import markup

RAW = "doc_id long, raw string"


_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def parse_new_pages(spark: SparkSession, landing: str, output: str, checkpoint: str, files: int | None = None) -> int:
    """Parse the pages that arrived in ``landing`` (JSON lines) since the last call into segments under ``output``.

    Exactly once: the file sink and the checkpoint commit each batch together.
    Returns the number of input rows. ``files`` bounds the files of a batch; the
    progress of all batches is kept until the end, so that none is missing in the number.
    """
    source = spark.readStream.schema(RAW)
    pages = (source.option("maxFilesPerTrigger", files) if files else source).json(landing)
    before = spark.conf.get(_PROGRESS)
    spark.conf.set(_PROGRESS, str(2**31 - 1))
    try:
        run = _started(pages, output, checkpoint)
    finally:
        spark.conf.set(_PROGRESS, before)
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def _started(pages: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return markup.segments(pages).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dead_letters(raw_text: DataFrame) -> DataFrame:
    """Pages whose recognition failed: (doc_id, error, raw)."""
    return raw_text.filter("error is not null").select("doc_id", "error", "raw")
