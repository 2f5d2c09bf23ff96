"""Sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "formlake", **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; master and memory come from the submitter."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly: few bytes can be much work, and a small file is one task."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    import tempfile

    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='formlake-')}").rstrip("/")
