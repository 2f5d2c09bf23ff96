"""Whole pages to fields: one row per page, its segments an array.

The grammar pass turns a page's text into its segments in one Arrow batch.
All else is expressions over that array: labels, the four strategies for a
value, the extent of a checkbox group and its resolution, continued comments, the
page's report. A page is one row from end to end, so nothing is shuffled and pages
without any segment keep their row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from formlake.functions import text
from formlake.functions.text import let
from formlake.operators.markup import page_segments
from formlake.session import spread

PARSER_VERSION = "pages-1"
STRATEGIES = ("inline", "grid", "geometric", "sequential")
#: Signs of a box in running text: in brackets with or without a tick, or as one sign.
BOX = rf"\[\s*[{text.TICKS}]?\s*\]|[{text.TICKED_BOXES}{text.EMPTY_BOXES}]"
_EMPTY = rf"\[\s*\]|[{text.EMPTY_BOXES}]"
_TICKED = rf"\[\s*[{text.TICKS}]\s*\]|[{text.TICKS}]"
_LETTER = "A-Za-zÄÖÜäöüß"
_PARTS = ("ord int", "text string", "x0 int", "y0 int", "x1 int", "y1 int", "tbl int", "row int", "col int")


@dataclass(frozen=True)
class Field:
    """``kind``: text, long_text (may go on in further lines), checkbox (with ``options``) or ignore (only bounds others)."""

    name: str
    labels: tuple[str, ...]
    kind: str = "text"
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Form:
    fields: tuple[Field, ...]
    stops: tuple[str, ...] = ()

    @property
    def told(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.kind != "ignore")

    def names(self) -> dict[str, tuple[str, ...]]:
        """Printed names by field; stop labels under names of their own."""
        return {f.name: f.labels for f in self.fields} | {f"__stop_{k}": (s,) for k, s in enumerate(self.stops)}


def pages_of(rows: DataFrame) -> DataFrame:
    """(doc_id, source, segs) of ``rows`` (doc_id, raw): struck-out text between its marks, empty cells kept; a null or empty page has no segments."""
    names = [p.split()[0] for p in _PARTS]
    kind = pa.list_(pa.struct([(p.split()[0], pa.string() if "string" in p else pa.int32()) for p in _PARTS]))

    def segments(raw: str | None) -> tuple[str, list[dict]]:
        found = page_segments(raw or "", whole=True)
        return found[0][5] if found else "plain", [dict(zip(names, (k, t, *(box or (None,) * 4), *place), strict=True)) for k, (t, box, *place, _) in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [segments(raw.as_py()) for raw in b["raw"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([s for s, _ in parsed], pa.string()), pa.array([p for _, p in parsed], kind)], names=["doc_id", "source", "segs"])

    part = StructType.fromDDL(", ".join(_PARTS))
    out = StructType([rows.schema["doc_id"]]).add("source", "string").add("segs", ArrayType(part))
    return spread(rows.select("doc_id", F.col("raw").cast("string").alias("raw"))).mapInArrow(run, out)


def _printed(labels: Sequence[str]) -> str:
    """A pattern for any of the names: blanks between words may be lost, German letters written as two."""
    written = set(labels)
    for label in labels:
        for one, two in text.EXPANSIONS:
            label = label.replace(one, two)
        written.add(label)
    return "(?:" + "|".join(r"\s*".join(map(re.escape, w.split())) for w in sorted(written, key=lambda w: (-len(w), w))) + ")"


def _opening(labels: Sequence[str]) -> str:
    """At the start of a text, where the blank behind a name may be lost too."""
    return rf"(?iu)^\s*{_printed(labels)}\s*[:.\-]?\s*"


def _inside(labels: Sequence[str]) -> str:
    """Anywhere, as words of their own."""
    return rf"(?iu)(?<![{_LETTER}]){_printed(labels)}(?![{_LETTER}])"


def with_labels(pages: DataFrame, form: Form) -> DataFrame:
    """Clean texts, and for each segment add its ``value``, ``hits`` (name, inline), ``is_label`` and ``label_only``.

    A name counts at a segment's start, and behind it only in a segment that starts with
    some name: inside a value it is none. The inline value goes up to the next
    other name, with a colon or without.
    """
    names = form.names()
    opening, inside = ({n: f(v) for n, v in names.items()} for f in (_opening, _inside))
    others = {n: _inside([v for m, vs in names.items() if m != n for v in vs]) for n in names} if len(names) > 1 else {}
    plain = lambda x: text.with_struck_text(x["text"])

    any_opening = _opening([v for vs in names.values() for v in vs])

    def either(t: Column, p: Column, pattern: str) -> Column:
        return t.rlike(pattern) | F.when(p != t, p.rlike(pattern)).otherwise(False)

    def hit(t: Column, p: Column, n: str) -> Column:
        rest = F.when(t.rlike(opening[n]), F.regexp_replace(t, opening[n], "")).when(t.rlike(inside[n]), F.get(F.split(t, inside[n], 2), 1))
        value = text.clean_value(F.get(F.split(rest, others[n], 2), 0) if n in others else rest)
        found = either(t, p, opening[n]) | either(t, p, inside[n])
        return F.when(found, F.struct(F.lit(n).alias("name"), F.coalesce(value, F.lit("")).alias("inline")))

    def marked(x: Column) -> Column:
        none = F.array().cast("array<struct<name:string,inline:string>>")

        def told(s: Column) -> Column:
            t, p = s["text"], s["plain"]
            only = reduce(Column.__or__, (t.rlike(o) & (text.clean_value(F.regexp_replace(t, o, "")) == "") for o in opening.values()))
            found = F.struct(F.array_compact(F.array(*[hit(t, p, n) for n in names])).alias("hits"), only.alias("only"))
            return F.when(either(t, p, any_opening), found).otherwise(F.struct(none.alias("hits"), F.lit(False).alias("only")))

        own = let(F.struct(x["text"].alias("text"), plain(x).alias("plain")), told)
        return let(own, lambda m: x.withField("hits", m["hits"]).withField("label_only", m["only"]).withField("value", text.clean_value(x["text"])))

    out = pages.withColumn("segs", F.transform("segs", lambda x: x.withField("text", text.clean_text(x["text"]))))
    out = out.withColumn("segs", F.filter("segs", lambda x: x["row"].isNotNull() | (plain(x) != "")))
    out = out.withColumn("segs", F.transform("segs", marked))
    return out.withColumn("segs", F.transform("segs", lambda x: x.withField("is_label", F.size(x["hits"]) > 0)))


def anchors(segs: Column) -> Column:
    """Array of the places of all names: name, inline value, and the segment's ord, box and cell."""
    return F.flatten(F.transform(segs, lambda x: F.transform(x["hits"], lambda h: F.struct(h["name"].alias("name"), h["inline"].alias("inline"), *[x[k].alias(k) for k in ("ord", "x0", "y0", "x1", "y1", "tbl", "row", "col")]))))


def _before(rows: Column, stop: Callable[[Column], Column]) -> Column:
    """The rows before the first at which ``stop`` holds."""
    at = F.array_position(F.transform(rows, lambda x: F.coalesce(stop(x), F.lit(False))), F.lit(True)).cast("int")
    return let(at, lambda k: F.when(k > 0, F.slice(rows, F.lit(1), F.greatest(k - 1, F.lit(0)))).otherwise(rows))


def _found(x: Column) -> Column:
    """Value and place, null for none."""
    return F.when(x.isNotNull(), F.struct(x["value"].alias("value"), x["ord"].alias("ord")))


def same_row(a: Column, b: Column) -> Column:
    """Boxes share a line: their heights overlap by three tenths of the lower one; centres would part a tall comment from its label."""
    low, high = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    return (high > low) & (10 * (high - low) >= 3 * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))


def grid_value(segs: Column, a: Column) -> Column:
    """The next filled cell of the label's row, up to the next bare label; else the cell below."""
    row = F.array_sort(F.transform(F.filter(segs, lambda x: (x["tbl"] == a["tbl"]) & (x["row"] == a["row"]) & (x["col"] > a["col"])), lambda x: F.struct(*[x[k].alias(k) for k in ("col", "ord", "value", "label_only")])))
    beside = F.get(F.filter(_before(row, lambda c: c["label_only"]), lambda c: c["value"] != ""), 0)
    below = F.filter(segs, lambda x: (x["tbl"] == a["tbl"]) & (x["row"] == a["row"] + 1) & (x["col"] == a["col"]) & ~x["label_only"] & (x["value"] != ""))
    return F.coalesce(_found(beside), _found(F.get(below, 0)))


def geometric_value(segs: Column, a: Column) -> Column:
    """The leftmost filled box right of a label outside tables, in its line and before the line's next label."""
    labels = F.filter(segs, lambda x: x["is_label"] & (x["ord"] != a["ord"]) & (x["x0"] > a["x1"]) & same_row(x, a))

    def nearest(bound: Column) -> Column:
        beside = F.filter(segs, lambda x: ~x["is_label"] & (x["value"] != "") & (x["x0"] >= a["x1"] - 5) & same_row(x, a) & (bound.isNull() | (x["x0"] < bound)))
        return F.array_min(F.transform(beside, lambda x: F.struct(x["x0"].alias("x0"), x["ord"].alias("ord"), x["value"].alias("value"))))

    return F.when(a["row"].isNull(), _found(let(F.array_min(F.transform(labels, lambda x: x["x0"])), nearest)))


def sequential_value(segs: Column, a: Column) -> Column:
    """The next filled segment in reading order, unless a label comes first."""
    following = F.get(F.filter(segs, lambda x: (x["ord"] > a["ord"]) & (x["is_label"] | (x["value"] != ""))), 0)
    return F.when(~following["is_label"], _found(following))


def continued(segs: Column, a: Column, first: Column, start: Column) -> Column:
    """``first`` and the values behind ``start`` up to a label, another table row or a box that is back in the label's column."""
    stop = lambda x: x["is_label"] | F.coalesce(x["row"] != a["row"], F.lit(False)) | F.coalesce(x["x0"] < a["x0"] - 5, F.lit(False))
    more = F.transform(_before(F.filter(segs, lambda x: x["ord"] > start), stop), lambda x: x["value"])
    return F.array_join(F.filter(F.concat(F.array(first), more), lambda v: v != ""), " ")


def group_extent(segs: Column, a: Column) -> Column:
    """Segments of a checkbox group: from its label up to the next one; in a table also the two rows below, whose cells carry no label."""
    near = lambda x: F.coalesce(x["row"] - a["row"] <= 2, F.lit(False))
    head = F.filter(_before(F.filter(segs, lambda x: x["ord"] > a["ord"]), lambda x: x["is_label"] & ~near(x)), lambda x: ~x["is_label"])
    main = F.concat(F.filter(segs, lambda x: x["ord"] == a["ord"]), head)
    below = lambda m: F.filter(segs, lambda x: (x["tbl"] == a["tbl"]) & (x["row"] > a["row"]) & (x["row"] <= a["row"] + 2) & ~F.array_contains(F.transform(m, lambda y: y["ord"]), x["ord"]))
    return let(main, lambda m: F.concat(m, below(m)))


def _by_grid(cells: Column) -> Column:
    """A row of options over a row of ticks, in the same columns of the same table."""
    options = F.filter(cells, lambda c: c["option"] > 0)
    rows = F.array_sort(F.array_distinct(F.transform(options, lambda c: F.struct(c["tbl"].alias("tbl"), c["row"].alias("row")))))

    def decided(r: Column) -> Column:
        own = F.filter(options, lambda c: (c["tbl"] == r["tbl"]) & (c["row"] == r["row"]))

        def under(o: Column, down: int) -> Column:
            return F.filter(cells, lambda c: (c["tbl"] == r["tbl"]) & (c["row"] == r["row"] + down) & F.exists(o, lambda y: y["col"] == c["col"]))

        def ticked(o: Column, marks: Column) -> Column:
            return F.filter(o, lambda y: F.exists(marks, lambda c: (c["col"] == y["col"]) & c["ticked"]))

        def told(o: Column) -> Column:
            marks = let(under(o, 1), lambda m: F.when(F.size(m) > 0, m).otherwise(under(o, 2)))
            return let(ticked(o, marks), lambda t: F.when(F.size(t) == 1, _status("grid", F.get(t, 0)["option"])).when(F.size(t) > 1, _status("ambiguous_grid")))

        return let(own, lambda o: F.when(F.size(o) >= 2, told(o)))

    return F.get(F.filter(F.transform(rows, decided), lambda d: d.isNotNull()), 0)


def _status(name: str, option: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("status"), (F.lit(0) if option is None else option).cast("int").alias("option"))


def _by_place(options: Column, marks: Column) -> Column:
    """As many boxed options as boxed marks: each mark belongs to the option with the least |dx| + |dy| of left edges and centres."""
    nearest = lambda m: F.array_min(F.transform(options, lambda o: F.struct((2 * F.abs(o["x0"] - m["x0"]) + F.abs(o["cy2"] - m["cy2"])).alias("far"), o["at"].alias("at"), o["option"].alias("option"))))["option"]
    ticked = F.transform(F.filter(marks, lambda m: m["ticked"]), nearest)
    told = let(ticked, lambda t: F.when(F.size(F.array_distinct(t)) == 1, _status("geometric", F.get(t, 0))).when(F.size(t) > 1, _status("ambiguous_geometric")))
    return F.when((F.size(marks) > 0) & (F.size(marks) == F.size(options)), told)


def _by_index(span: Column, options: Column) -> Column:
    """Boxes and options of equal number in reading order pair off, whichever comes first; else nobody can say which box is whose."""
    ticks = F.transform(F.regexp_extract_all(span, F.lit(f"({BOX})")), lambda m: ~m.rlike(f"^(?:{_EMPTY})$"))
    pattern = lambda o: F.concat(F.lit(r"(?iu)(?<![A-Za-z])\Q"), F.replace(o, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z])"))
    places = F.transform(options, lambda o, k: F.struct(F.regexp_instr(span, pattern(o)).alias("at"), o.alias("name"), (k + 1).alias("option")))
    found = F.array_sort(F.filter(places, lambda p: (p["at"] > 0) & (F.array_position(options, p["name"]) == p["option"])))

    def told(t: Column, o: Column) -> Column:
        ticked = F.filter(F.transform(t, lambda on, k: F.when(on, k)), lambda k: k.isNotNull())
        paired = let(ticked, lambda k: F.when(F.size(k) == 1, _status("paired", F.get(o, F.get(k, 0))["option"])).when(F.size(k) > 1, _status("ambiguous_paired")).otherwise(_status("none_ticked")))
        return F.when(F.size(t) == 0, _status("unresolved")).when(F.size(t) == F.size(o), paired).otherwise(_status("marker_count_mismatch"))

    return let(ticks, lambda t: let(found, lambda o: told(t, o)))


def resolved_checkbox(group: Column, options: Column) -> Column:
    """struct<status, option>: the number of the one option that is ticked beyond doubt, else 0.

    Three rules in the order of their evidence: a grid of options over ticks, boxes
    paired by place, boxes paired by index. Where a rule finds several ticks the
    status is ambiguous_<rule>, and no further one is asked; none_ticked,
    marker_count_mismatch and unresolved (no boxes at all) are what is left. A
    wrong option costs as much as none, so nothing is ever guessed.
    """
    lower = lambda o: F.transform(o, F.lower)
    number = lambda v: F.array_position(lower(options), F.lower(text.clean_value(v)))
    ticked = lambda t: F.btrim(t, F.lit(text.BLANKS)).rlike(f"^(?:{_TICKED})$")
    rows = F.transform(group, lambda x, k: x.withField("text", text.with_struck_text(x["text"])).withField("at", k))

    def told(g: Column) -> Column:
        cells = F.transform(F.filter(g, lambda x: x["row"].isNotNull()), lambda x: F.struct(*[x[k].alias(k) for k in ("tbl", "row", "col")], number(x["text"]).alias("option"), ticked(x["text"]).alias("ticked")))
        boxed = F.filter(g, lambda x: x["x0"].isNotNull())
        place = lambda x: (x["at"].alias("at"), x["x0"].alias("x0"), (x["y0"] + x["y1"]).alias("cy2"))
        named = F.filter(F.transform(boxed, lambda x: F.struct(*place(x), number(F.regexp_replace(x["text"], BOX, " ")).alias("option"))), lambda o: o["option"] > 0)
        marks = F.transform(F.filter(boxed, lambda x: F.btrim(x["text"], F.lit(text.BLANKS)).rlike(f"^(?:{BOX})$")), lambda x: F.struct(*place(x), ticked(x["text"]).alias("ticked")))
        span = F.array_join(F.transform(g, lambda x: x["text"]), "\n")
        return F.coalesce(let(cells, _by_grid), let(named, lambda o: let(marks, lambda m: _by_place(o, m))), let(span, lambda s: _by_index(s, options)))

    return let(rows, told)


def _field(segs: Column, places: Column, f: Column) -> Column:
    """Value, strategy, checkbox status and number of places of one field of a page."""
    none = F.lit("none")

    def from_text(a: Column) -> Column:
        ways = {"inline": F.struct(F.nullif(a["inline"], F.lit("")).alias("value"), a["ord"].alias("ord")), "grid": grid_value(segs, a), "geometric": geometric_value(segs, a), "sequential": sequential_value(segs, a)}
        named = lambda k: lambda w: F.when(w["value"].isNotNull(), F.struct(F.lit(k).alias("how"), w["value"].alias("value"), w["ord"].alias("ord")))
        first_way = F.coalesce(*[let(w, named(k)) for k, w in ways.items()])  # a way that no earlier one made needless

        def told(w: Column) -> Column:
            first = F.coalesce(w["value"], F.lit(""))
            whole = F.when(f["kind"] == "long_text", continued(segs, a, first, F.greatest(a["ord"], w["ord"]))).otherwise(first)
            return let(whole, lambda v: F.struct(v.alias("value"), F.when(v == "", none).otherwise(F.coalesce(w["how"], F.lit("sequential"))).alias("strategy"), F.lit(None).cast("string").alias("checkbox")))

        return let(first_way, told)

    def from_boxes(a: Column) -> Column:
        def told(r: Column) -> Column:
            value = F.coalesce(F.get(f["options"], r["option"] - 1), F.lit(""))
            return F.struct(value.alias("value"), F.when(value == "", none).otherwise(r["status"]).alias("strategy"), r["status"].alias("checkbox"))

        return let(let(group_extent(segs, a), lambda g: resolved_checkbox(g, f["options"])), told)

    def told(own: Column) -> Column:
        missing = F.struct(F.lit("").alias("value"), none.alias("strategy"), F.lit(None).cast("string").alias("checkbox"))
        a = F.get(own, 0)
        found = F.when(F.size(own) == 0, missing).when(f["kind"] == "checkbox", let(a, from_boxes)).otherwise(let(a, from_text))
        return let(found, lambda r: F.struct(f["name"].alias("field"), r["value"].alias("value"), r["strategy"].alias("strategy"), r["checkbox"].alias("checkbox"), F.size(own).alias("n_places")))

    return let(F.filter(places, lambda a: a["name"] == f["name"]), told)


def parse(rows: DataFrame, form: Form) -> DataFrame:
    """(doc_id, source, segs, places, fields) of ``rows`` (doc_id, raw): ``fields`` has a struct for every told field, in the form's order.

    Of several places of a name the first counts. A field without a place or a
    value is '' with the strategy ``none``. A page of null or empty text keeps its
    row, repeated ids theirs; other columns are not read.
    """
    every = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind"), F.array(*map(F.lit, f.options)).cast("array<string>").alias("options")) for f in form.told])
    pages = with_labels(pages_of(rows), form).withColumn("places", anchors(F.col("segs")))
    return pages.withColumn("fields", F.transform(every, lambda f: _field(F.col("segs"), F.col("places"), f)))


def field_rows(parsed: DataFrame) -> DataFrame:
    """(doc_id, field, value, strategy, checkbox, n_places): a row for every field of every page."""
    return parsed.select("doc_id", F.inline_outer("fields"))  # plain inline would have the whole parse reckoned again in a filter


def report(parsed: DataFrame) -> DataFrame:
    """The pages' reports: what was found, by which rule, and what was printed twice."""
    f = F.col("fields")
    by = lambda key: F.map_from_entries(F.transform(f, lambda x: F.struct(x["field"], x[key])))
    used = F.transform(f, lambda x: x["strategy"])
    counts = {s: F.size(used) - F.size(F.array_remove(used, s)) for s in STRATEGIES}
    most = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (s, n) in enumerate(counts.items())]))
    stops = F.array_sort(F.array_distinct(F.transform(F.filter("places", lambda a: F.startswith(a["name"], F.lit("__stop_"))), lambda a: a["name"])))
    return parsed.select(
        "doc_id",
        F.map_from_entries(F.transform(f, lambda x: F.struct(x["field"], x["n_places"] > 0))).alias("anchored"),
        F.map_filter(by("checkbox"), lambda _, v: v.isNotNull()).alias("checkbox"),
        F.transform(F.filter(f, lambda x: x["n_places"] > 1), lambda x: x["field"]).alias("duplicates"),
        stops.alias("stops_used"),
        F.size(F.filter(f, lambda x: x["n_places"] > 0)).alias("n_anchored"),
        F.size(f).alias("n_fields"),
        F.size("segs").alias("n_segments"),
        F.size(F.filter(f, lambda x: x["value"] != "")).alias("n_filled"),
        "source",
        by("strategy").alias("strategy"),
        F.create_map(*[c for s, n in counts.items() for c in (F.lit(s), n)]).alias("n_by_strategy"),
        F.when(most["n"] > 0, most["s"]).otherwise("none").alias("mode"),
        F.lit(PARSER_VERSION).alias("parser_version"),
    )
