"""Page markup to segments, and segments to field values.

Markup grammars have no relational form: one Arrow-batched pass turns a page's
text into segment rows. Everything after that (labels, grids, reading order,
the choice between strategies) is joins and windows over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import json_fields
from formlake.functions.text import STRUCK, UNSTRUCK

SEGMENTS = "doc_id long, ord int, text string, x0 int, y0 int, x1 int, y1 int, tbl int, row int, col int, source string"
_MOST_SPAN = 12
AT_ONCE = 256  # pages whose segments a worker holds before it hands them on
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section"}
_GROUNDED = re.compile(r"<\|ref\|>(.*?)<\|/ref\|>\s*<\|det\|>(.*?)<\|/det\|>(.*?)(?=<\|ref\|>|\Z)", re.S)
_BOXES = re.compile(r"\[([^\[\]]*)\]")
_RULE_LINE = re.compile(r"^[\s|:\-=]+$")


class _Page(HTMLParser):
    """Collects (text, box, table, row, column); a cell spans at most 12 columns and rows, and is emitted once, at its first column.

    Struck-out text stays, between ``STRUCK`` and ``UNSTRUCK``; so does an empty cell. The block that holds a page's own header is passed over.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.words: list[str] = []
        self.box: tuple | None = None
        self.skip = 0
        self.table, self.row, self.col = -1, -1, -1
        self.cell: tuple[int, int] | None = None
        self.taken: set[tuple[int, int]] = set()
        self.header = 0

    def flush(self) -> None:
        line = " ".join("".join(self.words).split())
        self.words = []
        if line:
            place = (self.table, *self.cell) if self.cell else (None, None, None)
            self.out.append((line, self.box, *place))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if self.header:
            self.header += tag == "div"
        elif tag == "div" and (own.get("data-label") or "").lower() == "page-header":
            self.flush()
            self.header = 1
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.table, self.row, self.taken = self.table + 1, -1, set()
        elif tag == "tr":
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self.flush()
            while (self.row, self.col) in self.taken:
                self.col += 1
            wide, high = (min(_MOST_SPAN, max(1, int(own.get(k) or 1))) if str(own.get(k) or 1).isdigit() else 1 for k in ("colspan", "rowspan"))
            self.taken |= {(self.row + r, self.col + c) for r in range(high) for c in range(wide)}
            self.cell = (self.row, self.col)
            self.col += wide
        elif tag == "br":
            if self.cell:
                self.words.append(" ")
            else:
                self.flush()
        elif tag == "input":
            kind = own.get("type", "text")
            self.words.append((" [x] " if "checked" in own else " [ ] ") if kind in ("checkbox", "radio") else f" {own.get('value') or ''} ")
        elif tag == "del":
            self.words.append(STRUCK)
        elif tag in _BLOCKS:
            self.flush()
            self.box = _box((own.get("data-bbox") or "").split()) if "data-bbox" in own else self.box if tag != "div" else None

    def handle_endtag(self, tag: str) -> None:
        if self.header:
            self.header -= tag == "div"
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "del":
            self.words.append(UNSTRUCK)
        elif tag in ("td", "th"):
            self.flush()
            if self.cell and (not self.out or self.out[-1][2:] != (self.table, *self.cell)):
                self.out.append(("", self.box, self.table, *self.cell))
            self.cell = None
        elif tag in _BLOCKS or tag == "table":
            self.flush()

    def handle_data(self, data: str) -> None:
        if not (self.skip or self.header):
            self.words.append(data.replace(STRUCK, "").replace(UNSTRUCK, ""))


def _box(parts: Sequence[str]) -> tuple | None:
    """Four numbers, fractions cut off; anything else is no box."""
    try:
        found = tuple(int(float(x)) for x in parts)
    except (ValueError, OverflowError):
        return None
    return found if len(found) == 4 else None


def _resolved(text: str) -> str:
    """Struck-out text goes, unless nothing else is left."""
    if STRUCK not in text:
        return text
    left = " ".join(re.sub(f"{STRUCK}[^{UNSTRUCK}]*{UNSTRUCK}?", " ", text).split())
    return left if left.strip(" \t:.-|*") else text.replace(STRUCK, "").replace(UNSTRUCK, "").strip()


def page_segments(raw: str, whole: bool = False) -> list[tuple]:
    """(text, box, table, row, column, source) of one page's text, in reading order; ``whole``: with empty cells, and what is struck out between its marks."""
    if not whole:
        resolved = ((_resolved(text), *rest) for text, *rest in page_segments(raw, True))
        return [x for x in resolved if x[0]]
    if "<|ref|>" in raw:
        out = []
        tables = 0
        for _, where, content in _GROUNDED.findall(raw):
            boxes = [b for b in (_box(x.split(",")) for x in _BOXES.findall(where)) if b]
            lines = [x.strip() for x in content.split("\n") if x.strip()]
            union = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None
            if "<table" in content.lower():
                cells = [x for x in page_segments(content, True) if x[2] is not None]
                out += [(text, union, tables + table, row, col, "grounded") for text, _, table, row, col, _ in cells]
                tables += 1 + max((x[2] for x in cells), default=-1)
                continue
            each = boxes if len(boxes) == len(lines) else [union] * len(lines)
            out += [(line, box, None, None, None, "grounded") for line, box in zip(lines, each, strict=True)]
        return out
    if re.search(r"<[a-zA-Z/!]", raw):
        page = _Page()
        page.feed(raw)
        page.close()
        page.flush()
        return [(*x, "html") for x in page.out]
    out, row = [], 0
    for line in raw.split("\n"):
        if line.strip().startswith("|"):
            if not _RULE_LINE.match(line):
                out += [(c.strip(), None, 0, row, k, "plain") for k, c in enumerate(line.strip().strip("|").split("|"))]
                row += 1
        elif line.strip() and not _RULE_LINE.match(line):
            out.append((line.strip(), None, None, None, None, "plain"))
    return out


def segments(pages: DataFrame) -> DataFrame:
    """Segments of ``pages`` (doc_id, raw); a null or empty page has none. A worker holds those of AT_ONCE pages at a time."""
    names, kinds = zip(*[x.split() for x in SEGMENTS.split(", ")], strict=True)
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                some = b.slice(at, AT_ONCE)
                rows = [(d, k, t, *(box or (None,) * 4), *rest) for d, raw in zip(some["doc_id"].to_pylist(), some["raw"].to_pylist(), strict=True) for k, (t, box, *rest) in enumerate(page_segments(raw or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return pages.select("doc_id", F.col("raw").cast("string").alias("raw")).mapInArrow(run, SEGMENTS)


def label_specs(spark: SparkSession, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """(label, prefix_re): each field's printed names, the longest first."""
    rows = [(f, r"(?iu)^\s*(?:" + "|".join(re.escape(v) for v in sorted(variants, key=len, reverse=True)) + r")(?![\p{L}])\s*[:.\-]?\s*") for f, variants in labels.items()]
    return spark.createDataFrame(rows, "label string, prefix_re string")


def split_at_labels(parts: DataFrame, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Segments that open with a label, cut before each further printed name that a colon follows; ``ord`` counts anew from 0.

    Pieces keep their segment's box and cell. A segment that opens with
    something else stays whole, so that a name inside a value is no label;
    a null or blank text stays as it is.
    """
    names = "|".join(re.escape(v) for v in sorted({v for variants in labels.values() for v in variants}, key=lambda v: (-len(v), v)))
    opens = F.rlike(F.col("text"), F.lit(rf"(?iu)^\s*(?:{names})(?!\p{{L}})"))
    cut = F.filter(F.split("text", rf"(?iu)(?<=\s)(?=(?:{names})\s*:)"), lambda x: F.trim(x) != "")
    pieces = F.when(opens, F.transform(cut, lambda x: F.trim(x))).otherwise(F.array("text"))
    each = parts.select("*", F.posexplode(pieces).alias("_k", "_piece")).withColumn("text", F.col("_piece"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "_k")) - 1
    return each.withColumn("ord", number).select(*parts.columns)


def field_values(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, field, value, strategy): the text behind the label, else the next cell of its row or the one below, else the box to its right, else the next segment.

    Every label of every document has a row; without a value it is '' and the
    strategy null. Of several places of a label the first counts.
    """
    hits = parts.join(F.broadcast(labels), F.rlike(F.col("text"), F.col("prefix_re")))  # a form's few labels
    w = Window.partitionBy("doc_id", "label").orderBy("ord")
    first = hits.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    rest = F.trim(F.regexp_replace("text", F.col("prefix_re"), F.lit("")))
    first = first.select("doc_id", F.col("label").alias("field"), F.col("ord").alias("at"), F.col("tbl").alias("t"), F.col("row").alias("r"), F.col("col").alias("c"), *[F.col(k).alias("l" + k) for k in ("x0", "y0", "x1", "y1")], F.nullif(rest, F.lit("")).alias("inline"))
    plain = parts.join(hits.select(F.col("doc_id").alias("_d"), F.col("ord").alias("_o")).distinct(), (F.col("doc_id") == F.col("_d")) & (F.col("ord") == F.col("_o")), "left_anti")
    other = plain.select(F.col("doc_id").alias("d"), "ord", "text", "tbl", "row", "col", "x0", "y0", "x1", "y1")
    met = first.join(other, F.col("doc_id") == F.col("d"), "left")
    same_row = (F.col("tbl") == F.col("t")) & (F.col("row") == F.col("r")) & (F.col("col") > F.col("c"))
    below = (F.col("tbl") == F.col("t")) & (F.col("row") == F.col("r") + 1) & (F.col("col") == F.col("c"))
    common = F.least("y1", "ly1") - F.greatest("y0", "ly0")
    beside = (common >= 0.3 * F.least(F.col("y1") - F.col("y0"), F.col("ly1") - F.col("ly0"))) & (F.col("x0") >= F.col("lx1"))
    after = (F.col("ord") > F.col("at")) & F.col("tbl").eqNullSafe(F.col("t"))
    place = F.when(same_row, F.struct(F.lit(0).alias("k"), F.col("col").alias("n"))).when(below, F.struct(F.lit(1).alias("k"), F.col("col").alias("n")))
    out = met.groupBy("doc_id", "field", "at", "inline").agg(
        F.min_by("text", place).alias("grid"),
        F.min_by(F.when(beside, F.col("text")), F.when(beside, F.col("x0"))).alias("geometric"),
        F.min(F.when(after, F.struct("ord", "text"))).alias("next"),
    )
    next_label = hits.select(F.col("doc_id").alias("_d"), F.col("ord").alias("_o")).distinct()
    stops = out.select("doc_id", "field", "at").join(next_label, (F.col("doc_id") == F.col("_d")) & (F.col("_o") > F.col("at"))).groupBy("doc_id", "field").agg(F.min("_o").alias("stop"))
    out = out.join(stops, ["doc_id", "field"], "left")
    sequential = F.when(F.col("stop").isNull() | (F.col("next.ord") < F.col("stop")), F.col("next.text"))
    choices = [("inline", F.col("inline")), ("grid", F.col("grid")), ("geometric", F.col("geometric")), ("sequential", sequential)]
    strategy = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choices])
    found = out.select("doc_id", "field", F.coalesce(*[c for _, c in choices]).alias("value"), strategy.alias("strategy"))
    every = parts.select("doc_id").distinct().join(F.broadcast(labels.select(F.col("label").alias("field"))), F.lit(True))  # documents times a form's fields
    return every.join(found, ["doc_id", "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def balanced_objects(raw: str) -> list[str]:
    """Top-level brace-balanced spans, in order."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(raw):
        if c == "{":
            start = k if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(raw[start : k + 1])
    return out


def last_matching_object(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(doc_id, fields map, n_objects): of the objects in ``raw`` the last that has one of the fields."""

    @F.pandas_udf("array<string>")
    def objects(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: balanced_objects(x or ""))

    wanted = F.array(*map(F.lit, fields))
    found = rows.select("doc_id", objects("raw").alias("objects"))
    parsed = found.withColumn("maps", F.transform("objects", lambda o: json_fields.fields_of(o)))
    fit = F.filter("maps", lambda m: m.isNotNull() & F.arrays_overlap(F.map_keys(m), wanted))
    return parsed.select("doc_id", F.try_element_at(fit, F.lit(-1)).alias("fields"), F.size("objects").alias("n_objects"))
