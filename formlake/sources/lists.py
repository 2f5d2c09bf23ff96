"""Lexicons and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions.text import document_number


def sorted_lexicon(rows: DataFrame, column: str) -> DataFrame:
    """(entry, ord): trimmed, distinct, sorted by code point."""
    out = rows.select(F.trim(F.col(column)).alias("entry")).filter("entry <> ''").distinct()
    return out.withColumn("ord", F.row_number().over(Window.orderBy("entry")))  # a lexicon is small


def first_occurrences(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(entry, ord): each entry once, where it first appears; blank ones skipped."""
    out = rows.select(F.col(column).alias("entry"), F.col(order).alias("pos")).filter("trim(entry) <> ''")
    out = out.groupBy("entry").agg(F.min("pos").alias("pos"))
    return out.select("entry", F.row_number().over(Window.orderBy("pos", "entry")).alias("ord"))  # a row per distinct entry


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV lexicon: its column ``name``, else its first."""
    rows = spark.read.option("header", True).csv(path)
    return sorted_lexicon(rows, "name" if "name" in rows.columns else rows.columns[0])


def read_lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    return sorted_lexicon(spark.read.text(path), "value")


def read_ordered_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry a line in file order; blank lines and comments skipped; the first of equal entries stays."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "entry"))
    lines = lines.withColumn("entry", F.trim("entry")).filter("entry <> '' and not startswith(entry, '#')")
    return first_occurrences(lines, "entry", "pos")


def read_lexicons(spark: SparkSession, path: str) -> DataFrame:
    """(lexicon, entry) of all text files at ``path``, each named by its file; blank lines and comments skipped, entries once."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("lexicon"), F.trim("value").alias("entry"))
    return lines.filter("entry <> '' and not startswith(entry, '#')").distinct()


def lexicon_sizes(entries: DataFrame) -> DataFrame:
    """(lexicon, n_entries)."""
    return entries.groupBy("lexicon").agg(F.count_distinct("entry").alias("n_entries"))


def with_document_key(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``doc_num`` and ``doc_key``: an id as the number that it is, or as text; one of the two is null."""
    key = F.trim(F.col(column).cast("string"))
    number = F.when(key.rlike("^[0-9]+$"), key.try_cast("long"))
    return rows.withColumns({"doc_num": number, "doc_key": F.when(number.isNull(), key)})


def read_split_ids(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(doc_num, doc_key) of the ids that a JSON file lists under ``split``; a file without that key raises."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "map<string,string>")
    if raw.filter(~F.coalesce(F.map_contains_key(listed, F.lit(split)), F.lit(False))).limit(1).count():
        raise KeyError(f"no split of this name: {split}")
    ids = raw.select(F.explode(F.from_json(F.element_at(listed, split), "array<string>")).alias("id"))
    return with_document_key(ids, "id").select("doc_num", "doc_key")


def read_manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_num, doc_key) of the entries of a JSON array; other keys than ``doc_id`` are not read."""
    return with_document_key(spark.read.schema("doc_id string").option("multiLine", True).json(path), "doc_id").select("doc_num", "doc_key")


def in_document_order(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of ``with_document_key``, numbers before text, then by value; a limit takes the first ones of all."""
    ordered = rows.orderBy(F.col("doc_num").isNull(), "doc_num", "doc_key")
    return ordered if limit is None else ordered.limit(limit)


def missing_documents(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct (doc_num, doc_key) of ``wanted`` that ``found`` has not."""
    w = wanted.select("doc_num", "doc_key").filter("doc_num is not null or doc_key is not null").distinct()
    f = found.select(F.col("doc_num").alias("_n"), F.col("doc_key").alias("_k"))
    return w.join(f, F.coalesce(F.col("doc_num").cast("string"), F.concat(F.lit("s"), "doc_key")) == F.coalesce(F.col("_n").cast("string"), F.concat(F.lit("s"), "_k")), "left_anti")


def require_documents(wanted: DataFrame, found: DataFrame, shown: int = 10) -> None:
    """Raises an error that names the first ``shown`` of the wanted documents that were not found."""
    first = in_document_order(missing_documents(wanted, found), shown + 1).collect()
    if first:
        names = [str(r["doc_key"] if r["doc_num"] is None else r["doc_num"]) for r in first[:shown]]
        raise ValueError("documents not found: " + ", ".join(names) + (", ..." if len(first) > shown else ""))


def in_files(paths: DataFrame, wanted: DataFrame, column: str = "path") -> DataFrame:
    """Rows of ``paths`` whose document, the last number in the file's name, is wanted; all of them must be there."""
    keyed = paths.withColumn("doc_num", document_number(F.regexp_extract(column, "[^/]*$", 0))).withColumn("doc_key", F.lit(None).cast("string"))
    require_documents(wanted, keyed)
    return keyed.join(wanted.filter("doc_num is not null").select("doc_num").distinct(), "doc_num", "left_semi")
