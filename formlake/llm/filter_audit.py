"""Filter interaction audit: every order of the filters replayed over every document.

A document's failures are one integer (bit k set: it fails filter k). Documents
are crossed with the orders, a broadcast table of fixed size (n! rows for n
filters) whose columns hold the filters' bits in the order of application. The
first failing step of each pair is a comparison of these bits, the steps are
exploded, and all counts are conditional sums, first added up in the task that
made the rows. Only (part, order, step) groups are shuffled, so a part that
holds most of the rows costs no more than a small one.

Texts are read once: their measures and digests are written to the working
folder. Copies are found by a grouping of the digests (partial minima first)
and a join back, in which the rows of one text are dealt out by a salt from their
ids, so that a text that makes up much of the table meets no single task.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.work import materialise

#: Filter: condition under which a text fails, over the columns of ``measured``.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
#: n! orders are broadcast, n * n! rows made of each document.
MOST_FILTERS = 6
#: Parts into which the copies of one text are dealt.
SALTS = 64


def measured(docs: DataFrame, part: str | Column) -> DataFrame:
    """(id, part, digest, n_words, n_distinct, n_upper, n_chars, has_symbol) of each whole text; a null text is empty, a null part ''."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), part.alias("part"), text.alias("t")).withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return rows.select(
        "id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length("t").cast("long").alias("n_chars"),
        F.rlike("t", F.lit("[#$%&*|]")).alias("has_symbol"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """Add ``is_copy``: a row of a smaller id has the same text. Rows without an id are no copies, and have none."""
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = salted.join(firsts, ["digest", "salt"], "left")
    return met.withColumn("is_copy", F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))).drop("first_id", "salt")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic`` from ``labels`` (doc_id, quality, toxic); of repeated rows of an id one that says 1 decides, an id without a row is neither."""
    one = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(one, "id", "left").na.fill(False, ["good", "toxic"])


def orders(spark, names: list[str]) -> DataFrame:
    """(place, filter_order, b0, b1, ...): all orders of the filters, b<k> the bit of the filter applied k-th."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; {MOST_FILTERS} are the most")
    rows = [(k, "".join(p), *(1 << names.index(x) for x in p)) for k, p in enumerate(permutations(names))]
    return spark.createDataFrame(rows, "place int, filter_order string, " + ", ".join(f"b{k} int" for k in range(len(names))))


def replay(rows: DataFrame, names: list[str]) -> DataFrame:
    """Counts for every part, order and step of ``rows`` (part, failed, good, toxic); without rows there are none."""
    n, every = len(names), orders(rows.sparkSession, names)
    met = rows.select("part", "failed", "good", "toxic").crossJoin(F.broadcast(every.drop("filter_order")))  # n! rows, n at most MOST_FILTERS
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(F.col("failed").bitwiseAND(F.col(f"b{k}")) != 0, k + 1).otherwise(first)
    steps = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(n)])).alias("s")
    each = met.select("part", "failed", "good", "toxic", "place", first.alias("first"), steps).select("*", "s.step", "s.bit")
    here, fails = F.col("first") == F.col("step"), F.col("failed").bitwiseAND(F.col("bit")) != 0
    out = each.groupBy("part", "place", "step", "bit").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("failed") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    return out.join(F.broadcast(every.select("place", "filter_order")), "place")


def audit(docs: DataFrame, labels: DataFrame, part: str | Column = "lang", filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of ``filters``.

    ``docs`` (doc_id, text, ``part``); other columns, whatever their names, are
    not read. A null text is empty, a null part ''. Repeated rows count as often
    as they stand there, and rows of one id are no copies of each other. No
    documents give no rows; documents without labels are neither good nor toxic.
    ``shapley``: what the step's filter removes, added up over all orders.
    """
    names = list(filters)
    rows = with_copies(materialise(measured(docs, part), "measured"))
    failed = F.lit(0)
    for k, condition in enumerate(filters.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), 1 << k).otherwise(0))
    rows = with_labels(rows.select("id", "part", failed.alias("failed")), labels)
    whole = Window.partitionBy("part", "bit")  # (n - 1)! orders times n steps, whatever the number of documents
    return replay(rows, names).withColumn("shapley", F.sum("removed").over(whole)).drop("place", "bit")
