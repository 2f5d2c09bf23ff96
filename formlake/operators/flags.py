"""Advisory flags: reasons to look at a cell, never changes to it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions import dates, json_fields


def first_reason(rows: DataFrame, value: Column, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows with the reason of the first check that holds; empty values are never flagged."""
    reason = F.when(value.isNull() | (value == ""), None)
    for check, text in checks:
        reason = reason.when(check, text)
    return rows.withColumn("reason", reason).filter("reason is not null")


def checkbox_reason(status: Column, value: Column, options: Column) -> Column:
    """A group whose mark is not clear, or whose value is no option."""
    return F.when(status.isNotNull() & (status != "ok"), F.concat(F.lit("checkbox "), status)).when(status.isNull() & (value == ""), "no option chosen").when(status.isNull() & ~F.array_contains(options, value), "not an option")


def low_confidence(cells: DataFrame, confidences: DataFrame, threshold: float, reviewed: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, reason) of cells scored below the threshold; a missing score counts as 0."""
    met = cells.join(confidences.select("doc_id", "field", "conf_min"), ["doc_id", "field"], "left")
    if reviewed is not None:
        met = met.join(reviewed.select("doc_id").distinct(), "doc_id", "left_anti")
    score = F.coalesce(F.nanvl("conf_min", F.lit(0.0)), F.lit(0.0))
    return met.filter(score < threshold).select("doc_id", "field", F.format_string("confidence %.2f", score).alias("reason"))


def confidence_totals(rows: DataFrame, keys: list[str], score: str, threshold: float) -> DataFrame:
    """(keys, n_scored, n_unscored, n_below): unscored counts as below."""
    c = F.col(score)
    return rows.groupBy(*keys).agg(F.count(c).alias("n_scored"), F.count_if(c.isNull()).alias("n_unscored"), F.count_if(F.coalesce(c, F.lit(0.0)) < threshold).alias("n_below"))


def span_confidence(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, field, n_tokens, conf_min, conf_first, conf_mean) of the tokens that a value's span touches.

    ``spans``: (doc_id, field, s, e); ``tokens``: (doc_id, pos, ts, te, logp).
    Fields without a token have no row in ``tokens`` and get null scores. ``pos``, of any
    type that can be ordered, should be unique in a document: of tokens at one place any may be the first.
    A token without a score counts nowhere.
    """
    t = tokens.withColumnRenamed("doc_id", "_doc")
    met = spans.join(t.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("ts") < F.col("e")) & (F.col("te") > F.col("s")), "left")
    return met.groupBy("doc_id", "field").agg(F.count("logp").alias("n_tokens"), F.exp(F.min("logp")).alias("conf_min"), F.exp(F.min_by("logp", F.when(F.col("logp").isNotNull(), F.col("pos")))).alias("conf_first"), F.exp(F.avg("logp")).alias("conf_mean"))


def field_confidences(pages: DataFrame, tokens: DataFrame, values: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(doc_id, field, span, n_tokens, conf_min, conf_first, conf_mean, span_matches_value) for each of ``fields`` of every page.

    ``pages``: (doc_id, raw), ids unique; ``tokens``: (doc_id, pos, text, logp); ``values``:
    (doc_id, field, value), what was stored. A field's tokens are those that its value's
    span in the raw text touches; an empty value is scored by its quotes. ``span`` is the value's kind,
    ``missing`` without the key, and ``decode_mismatch`` for all fields of a page whose
    tokens don't add up to its text; these have no tokens and null scores. A null raw text is empty.
    """
    token = F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), "logp")
    told = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(token)), lambda t: t.dropFields("pos")).alias("tokens"))
    stored = values.groupBy("doc_id").agg(F.collect_list(F.struct("field", "value")).alias("stored"))
    return page_confidences(pages.join(told.hint("merge"), "doc_id", "left"), stored, fields)


def page_confidences(pages: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """As ``field_confidences``, of ``pages`` (doc_id, raw, tokens) and ``stored`` (doc_id, stored) with a row for each page.

    ``tokens`` is an array of struct<text, logp> in order, ``stored`` one of struct<field, value>. One Arrow pass
    scores a page's fields inside its row, so only what was found, and not the tokens, meets the stored values.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    texts, logps = F.transform("tokens", lambda t: F.coalesce(t["text"], F.lit(""))), F.transform("tokens", lambda t: t["logp"].cast("double"))
    flat = pages.select("doc_id", F.coalesce("raw", F.lit("")).alias("raw"), *[F.coalesce(c, F.array().cast(f"array<{k}>")).alias(n) for c, k, n in ((texts, "string", "texts"), (logps, "double", "logps"))])
    found = flat.mapInArrow(_scoring(tuple(fields)), f"doc_id {kind}, found array<{_FOUND}>")
    met = found.hint("merge").join(stored.hint("merge"), "doc_id", "left")  # both grow with the pages and look small before they are made: neither is sent to the driver
    each = met.select("doc_id", "stored", F.inline("found"))
    plain = (F.col("kind") == "string") & ~F.rlike("raw", F.lit(r'["\\\x00-\x1f]'))  # most texts are what a JSON reader makes of them
    parsed = F.when(plain, F.btrim("raw")).when(F.col("kind").isNotNull(), json_fields.value_as_parsed(F.struct("kind", "raw")))
    same = (F.col("n_tokens") > 0) & F.exists("stored", lambda v: (v["field"] == F.col("field")) & (v["value"] == F.col("parsed")))
    told = each.select("doc_id", "stored", "field", "span", "n_tokens", parsed.alias("parsed"), *[F.exp(c).alias(f"conf_{c}") for c in ("min", "first", "mean")])
    return told.select("doc_id", "field", "span", "n_tokens", "conf_min", "conf_first", "conf_mean", F.coalesce(same, F.lit(False)).alias("span_matches_value"))


AT_ONCE = 256
_FOUND = "struct<field:string,span:string,n_tokens:bigint,min:double,first:double,mean:double,kind:string,raw:string>"


def _scoring(fields: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow pass of ``page_confidences``: (doc_id, found), a struct for each field with logarithms for scores; a worker holds AT_ONCE pages at a time."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    names = [x.partition(":")[0] for x in _FOUND[7:-1].split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = json_fields.text_spans(fields)
        for b in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            lengths, scores = pc.utf8_length(b["texts"].flatten()).to_numpy().tolist(), b["logps"].flatten()
            scores = scores.to_pylist() if scores.null_count else scores.to_numpy().tolist()
            cuts = [0, *accumulate(b["texts"].value_lengths().to_numpy().tolist())]
            told = pc.equal(pc.binary_join(b["texts"].cast(pa.list_(pa.string())), ""), b["raw"]).to_pylist()
            rows = []
            for k, raw in enumerate(b["raw"].to_pylist()):
                if not told[k]:
                    rows += [(f, "decode_mismatch", 0, None, None, None, None, None) for f in fields]
                    continue
                ends, own = list(accumulate(lengths[cuts[k] : cuts[k + 1]])), scores[cuts[k] : cuts[k + 1]]
                for f, v in zip(fields, spans(raw), strict=True):
                    if v is None:
                        rows.append((f, "missing", 0, None, None, None, None, None))
                        continue
                    kind, s, e, outer = v
                    piece = raw[s:e]
                    if e <= s:
                        s, e = s - outer, e + outer
                    p = []
                    for at in range(bisect_right(ends, s), len(ends)):
                        if (ends[at - 1] if at else 0) >= e:
                            break
                        if own[at] is not None:
                            p.append(own[at])
                    least = min([x for x in p if x == x] or p, default=None)  # NaN is the greatest
                    rows.append((f, kind, len(p), least, p[0] if p else None, sum(p) / len(p) if p else None, kind, piece))
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            found = pa.ListArray.from_arrays(pa.array(range(0, len(rows) + 1, len(fields)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b["doc_id"], found], names=["doc_id", "found"])

    return run


#: Cells whose least token probability is below this are worth a look.
LEAST_CONFIDENCE = 0.75
_MAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"


def format_reason(value: Column, today: Column) -> Column:
    """Why a value does not look like one of its field, null where nothing speaks against it; the first reason counts.

    Reads the field's ``type``, ``rule``, ``pattern`` and ``options`` (array of names) and the
    group's ``status`` (null: nothing was measured, then the value must be an option). Other
    empty values are never doubted.
    """
    rule, group = F.coalesce("rule", F.lit("none")), F.col("type") == "checkbox_group"
    patterned = F.coalesce((F.col("type") == "number") & (F.col("pattern") != "") & (rule != "date"), F.lit(False))
    foreign = F.coalesce((F.size("options") > 0) & ~F.array_contains("options", value), F.lit(False))
    box = F.when(F.col("status").isNotNull(), F.when(F.col("status") != "ok", F.concat(F.lit("checkbox: "), "status"))).when(value == "", "checkbox: no option recognised").when(foreign, F.concat(F.lit("checkbox: no such option: "), value))
    date = F.when(~dates.birth_date_shape(value), "not a calendar date").otherwise(dates.age_reason(dates.value_date(value), today))
    return (
        F.when(F.col("type").isNull(), None)
        .when(group, box)
        .when(value == "", None)
        .when((rule == "name") & value.rlike(r"\d"), "digits in a name")
        .when(patterned, F.when(~F.regexp_like(value, F.concat(F.lit("^(?:"), "pattern", F.lit(")"))), "not in the number's format"))
        .when(rule == "date", date)
        .when((rule == "email") & ~value.rlike(_MAIL), "not like an e-mail address")
    )


#: Cells that one task of ``plausibility`` holds, about.
CELLS_A_TASK = 250_000


def _marked(cells: DataFrame, other: DataFrame | None, keys: Sequence[str], name: str, value: Column | None = None, parts: int = 1) -> DataFrame:
    """``cells`` with column ``name``: ``value`` of the row of ``other`` with the same keys, null without one; ``other`` is dealt into ``parts`` first, so that no task sums up a whole file."""
    if other is None:
        return cells.withColumn(name, F.lit(None).cast("boolean"))
    told = F.lit(True) if value is None else value
    side = other.repartition(parts, *keys).groupBy(*[F.col(k).alias(f"_{name}_{k}") for k in keys]).agg(F.max(told).alias(name))
    met = cells.join(side, [F.col(k) == F.col(f"_{name}_{k}") for k in keys], "left")
    return met.drop(*[f"_{name}_{k}" for k in keys])


def plausibility(
    cells: DataFrame, fields: DataFrame, today: Column, statuses: DataFrame | None = None, confidences: DataFrame | None = None, threshold: float = LEAST_CONFIDENCE,
    changed: DataFrame | None = None, bleeding: DataFrame | None = None, skipped: DataFrame | None = None, reviewed: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, field, reason) of the cells that call for a look, ordered by both; several reasons of a cell are joined by "; ".

    ``cells``: (doc_id, field, value), null is empty; ``fields``: (field, type, rule, pattern,
    options array<string>), names unique; columns not among them get no format check.
    ``statuses``: (doc_id, field, status) of checkbox groups. ``confidences``: (doc_id, field,
    conf_min); where given, a missing or NaN score is as low as one can be, and the reason of a
    cell in ``changed`` says that the score is of the raw value. ``bleeding``: (doc_id, field, demo).
    The documents ``skipped`` (demonstrations) and the cells ``reviewed`` by a person are not
    doubted for confidence or bleeding, only for their format. Rows of a key given twice
    count once; the result has a row for each row of ``cells`` with a reason. ``cells`` are
    counted first: a task holds about CELLS_A_TASK of them, however many there are.
    """
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CELLS_A_TASK))
    key = ["doc_id", "field"]
    own = fields.select(F.col("field").alias("_field"), "type", "rule", "pattern", "options")
    met = cells.select("doc_id", "field", F.coalesce("value", F.lit("")).alias("value")).join(F.broadcast(own), F.col("field") == F.col("_field"), "left").repartition(parts, *key)
    met = _marked(met, statuses, key, "status", F.col("status") if statuses is not None else None, parts)
    met = met.withColumn("status", F.col("status").cast("string"))
    score = None if confidences is None else F.nanvl(F.col("conf_min").cast("double"), F.lit(None).cast("double"))
    met = _marked(met, confidences, key, "score", score, parts)
    met = _marked(met, changed, key, "was_changed", parts=parts)
    met = _marked(met, reviewed, key, "was_reviewed", parts=parts)
    met = _marked(met, skipped, ["doc_id"], "was_skipped", parts=parts)
    if bleeding is None:
        met = met.withColumn("demos", F.lit(None).cast("string"))
    else:
        seen = bleeding.groupBy(F.col("doc_id").alias("_bd"), F.col("field").alias("_bf")).agg(F.array_join(F.array_sort(F.collect_set(F.col("demo").cast("string"))), ", ").alias("demos"))  # demonstrations are few
        met = met.join(seen, (F.col("doc_id") == F.col("_bd")) & (F.col("field") == F.col("_bf")), "left")
    of_model = F.col("was_reviewed").isNull() & F.col("was_skipped").isNull()
    low = F.lit(None).cast("string")
    if confidences is not None:
        text = F.when(F.col("score").isNull(), "no confidence").otherwise(F.format_string(f"low confidence (%.2f < {threshold:.2f})", F.col("score")))
        text = F.concat(text, F.when(F.col("was_changed"), " of the raw value").otherwise(""))
        low = F.when(of_model & (F.coalesce("score", F.lit(0.0)) < threshold), text)
    bled = F.when(of_model & F.col("demos").isNotNull(), F.concat(F.lit("as in demonstration "), "demos"))
    reason = F.nullif(F.concat_ws("; ", format_reason(F.col("value"), today), low, bled), F.lit(""))
    return met.select("doc_id", "field", reason.alias("reason")).filter("reason is not null").orderBy("doc_id", "field", "reason")
