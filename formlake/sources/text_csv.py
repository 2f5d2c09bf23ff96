"""CSV that keeps text as text: no types are inferred, '' stays '', line breaks survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from formlake.operators.cells import roundtrip_mismatches

_OPTIONS = {"header": True, "quoteAll": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def assert_text(df: DataFrame, key: str) -> None:
    """Numbers have lost their leading zeros already: refuse them."""
    wrong = [f.name for f in df.schema if f.name != key and not isinstance(f.dataType, StringType)]
    if wrong:
        raise TypeError(f"columns that are not text: {', '.join(wrong)}")


def write_text_csv(df: DataFrame, path: str, key: str) -> None:
    """Write, read back and compare every cell; raises if one differs."""
    assert_text(df, key)
    fields = [c for c in df.columns if c != key]
    df.na.fill("", fields).write.options(**_OPTIONS).csv(path)
    wrong = roundtrip_mismatches(df, read_text_csv(df.sparkSession, path, df.columns), key, fields).limit(10).collect()
    if wrong:
        raise ValueError(f"cells changed on the way: {wrong}")


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.options(**_OPTIONS).schema(schema).csv(path).na.fill("")


def with_integer_key(df: DataFrame, key: str) -> DataFrame:
    """The key as a number where it is one in every row."""
    odd = df.filter(~F.col(key).rlike("^[0-9]+$")).limit(1).count()
    return df if odd else df.withColumn(key, F.col(key).cast("long"))
