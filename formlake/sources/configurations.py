"""Form configurations as tables: many layouts at once, a row per field.

Fields: (layout, ord, field, type, rule, pattern, lexicon, options, roi, labels,
note), where ``options`` is array<struct<name string, box array<double>>>,
``roi`` array<double> and ``labels`` array<string>; ``ord`` orders the fields of
a layout. ``rule`` is what was set; ``effective_rule`` says what it comes to. No
function needs more of a layout in one place than its own fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.sources.layouts import TYPES

# The rules of fields, the types of the field table, the patterns that it offers by name.
RULES = ("none", "numeric", "date", "lexicon", "email", "street_suffix", "name", "llm")
TABLE_TYPES = {"short": "text", "long": "long_text", "checkbox": "checkbox_group", "ignore": "ignore"}
OLD_TABLE_TYPES = {"text/number": "short", "long text": "long"}
NAMED_PATTERNS = {
    "decimal amount (e.g. 256,99 €)": r"^\d+([.,]\d+)?\s?€?$",
    "phone number (digits, spaces, ()+-/)": r"^[\d\s()+\-/]+$",
    "house number (e.g. 12a)": r"^\d+[a-zA-Z]?$",
    "postal code (exactly 5 digits)": r"^\d{5}$",
    "whole number (digits only)": r"^\d+$",
}
CUSTOM = "custom regex"

_OPTIONS = "array<struct<name string, box array<double>>>"
_DOCUMENT = (
    "layout string, coordinate_space string, reference_size array<int>, stop_labels array<string>, fields array<struct<name string, type string, "
    "roi array<double>, postprocess string, pattern string, lexicon string, options string, label string, note string>>"
)


def effective_rule() -> Column:
    return F.coalesce("rule", F.when(F.col("type") == "number", "numeric").otherwise("none"))


def _choice(of: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The value that ``table`` has for ``of``."""
    out = otherwise
    for key, value in table.items():
        out = F.when(of == key, value).otherwise(out)
    return out


def _member(name: str, value: Column) -> Column:
    """``"name":value`` of a JSON object, null where the value is null."""
    whole = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), F.substr(whole, F.lit(2), F.length(whole) - 2))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def documents(fields: DataFrame, coordinate_space: str = "absolute", stop_labels: DataFrame | None = None) -> DataFrame:
    """(layout, document): each layout as the JSON text of a configuration file.

    Keys without a value are left out, but for ``roi``, which is null where
    nothing was measured. Options are an object of boxes where all have one,
    else a list of names. One label is a string, several are a list.
    ``stop_labels``: (layout, ord, label), optional.
    """
    measured = F.forall("options", lambda o: o["box"].isNotNull())
    options = F.coalesce(
        _member("options", F.when(measured & (F.size("options") > 0), F.map_from_entries("options"))),
        _member("options", F.when(F.size("options") > 0, F.transform("options", lambda o: o["name"]))),
    )
    labels = F.coalesce(_member("label", F.when(F.size("labels") == 1, F.get("labels", 0))), _member("label", F.when(F.size("labels") > 1, F.col("labels"))))
    plain = [_member(k, F.nullif(F.col(c), F.lit(""))) for k, c in (("postprocess", "rule"), ("pattern", "pattern"), ("lexicon", "lexicon"), ("note", "note"))]
    entry = _object(_member("name", F.col("field")), _member("type", F.col("type")), F.coalesce(_member("roi", F.col("roi")), F.lit('"roi":null')), *plain, options, labels)
    rows = fields.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("entries"))
    stops = F.lit(None).cast("array<string>")
    if stop_labels is not None:
        listed = stop_labels.groupBy(F.col("layout").alias("_l")).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("_stops"))
        rows = rows.join(listed, F.col("layout") == F.col("_l"), "left")
        stops = F.transform("_stops", lambda s: s["label"])
    entries = F.array_join(F.transform("entries", lambda e: e["entry"]), ",")
    whole = _object(_member("layout", F.col("layout")), _member("coordinate_space", F.lit(coordinate_space)), _member("stop_labels", stops), F.concat(F.lit('"fields":['), entries, F.lit("]")))
    return rows.select("layout", whole.alias("document"))


def parsed(texts: DataFrame, text: str = "document", name: str = "layout") -> DataFrame:
    """Forms (layout, coordinate_space, stop_labels, fields) of JSON texts; unknown keys are ignored.

    ``name`` is the column whose value names a layout that does not name itself.
    A text that is no JSON object has null ``fields``.
    """
    d = F.from_json(F.col(text), _DOCUMENT)
    return texts.select(F.col(name).alias("_name"), d.alias("d")).select(
        F.coalesce("d.layout", "_name").alias("layout"), F.coalesce("d.coordinate_space", F.lit("absolute")).alias("coordinate_space"), F.coalesce("d.stop_labels", F.array().cast("array<string>")).alias("stop_labels"), F.col("d.fields").alias("fields")
    )


def read_configurations(spark: SparkSession, path: str) -> DataFrame:
    """Forms of the configuration files at ``path``, a file, folder or glob; each named as in it, else by its file."""
    raw = spark.read.text(path, wholetext=True)
    return parsed(raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("layout"), F.col("value").alias("document")))


def fields_of(forms: DataFrame) -> DataFrame:
    """The fields of forms, in the order of their lists."""
    rows = forms.select("layout", F.posexplode("fields").alias("ord", "f"))
    boxes = F.transform(F.map_entries(F.from_json("f.options", "map<string,array<double>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("box")))
    names = F.transform(F.from_json("f.options", "array<string>"), lambda n: F.struct(n.alias("name"), F.lit(None).cast("array<double>").alias("box")))
    options = F.when(F.startswith("f.options", F.lit("[")), names).otherwise(boxes)
    labels = F.when(F.startswith("f.label", F.lit("[")), F.from_json("f.label", "array<string>")).when(F.col("f.label") != "", F.array("f.label"))
    return rows.select(
        "layout", "ord", F.col("f.name").alias("field"), "f.type", F.col("f.postprocess").alias("rule"), "f.pattern", "f.lexicon",
        F.coalesce(options, F.array().cast(_OPTIONS)).cast(_OPTIONS).alias("options"), "f.roi", F.coalesce(labels, F.array().cast("array<string>")).alias("labels"), "f.note",
    )


def listing(forms: DataFrame) -> DataFrame:
    """(layout, n_fields, has_geometry): the last is true where each field has a box, and there is a field."""
    n = F.coalesce(F.size("fields"), F.lit(0))
    return forms.select("layout", n.alias("n_fields"), ((n > 0) & F.coalesce(F.forall("fields", lambda f: f["roi"].isNotNull()), F.lit(False))).alias("has_geometry"))


def labels_of(fields: DataFrame) -> DataFrame:
    """(layout, field, ord, label): a row for each accepted spelling of a field's caption."""
    return fields.select("layout", "field", F.posexplode("labels").alias("ord", "label"))


def _thin(box: Column) -> Column:
    return F.coalesce((F.get(box, 0) >= F.get(box, 2)) | (F.get(box, 1) >= F.get(box, 3)), F.lit(True))


def _outside(box: Column) -> Column:
    return F.exists(box, lambda v: ~v.between(0, 1))


def broken_rules(fields: DataFrame, relative: bool = False) -> DataFrame:
    """(layout, ord, field, problem): what a layout must not have, a row for each problem of a field.

    A field without geometry (``roi`` null) is fine, options without boxes too.
    ``relative``: boxes must lie between 0 and 1.
    """
    roi, rule, group = F.col("roi"), effective_rule(), F.col("type") == "checkbox_group"
    n = F.coalesce(F.size("options"), F.lit(0))
    boxes = F.filter(F.transform("options", lambda o: o["box"]), lambda b: b.isNotNull())
    some = lambda test: F.coalesce(F.exists(boxes, test), F.lit(False))
    checks = [
        (~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "unknown type"),
        (~rule.isin(*RULES), "unknown rule"),
        (F.size(roi) != 4, "box without four values"),
        ((F.size(roi) == 4) & _thin(roi), "empty box"),
        (_outside(roi) if relative else F.lit(False), "box beyond the page"),
        (group & (n == 0), "checkbox group without options"),
        (group & (n == 1), "checkbox group of one option"),
        (~group & (n > 0), "options of no checkbox group"),
        (group & some(lambda b: F.size(b) != 4), "option's box without four values"),
        (group & some(lambda b: (F.size(b) == 4) & _thin(b)), "empty box of an option"),
        (group & some(_outside), "option's box beyond its field"),
        ((rule == "numeric") & (F.coalesce("pattern", F.lit("")) == ""), "numeric rule without a pattern"),
        ((rule == "lexicon") & (F.coalesce("lexicon", F.lit("")) == ""), "lexicon rule without a lexicon"),
        (F.col("_same") > 1, "name used twice"),
    ]
    found = F.array_compact(F.array(*[F.when(test, told) for test, told in checks]))
    counted = fields.withColumn("_same", F.count("*").over(Window.partitionBy("layout", "field")))
    return counted.select("layout", "ord", "field", F.explode(found).alias("problem"))


def field_table(fields: DataFrame) -> DataFrame:
    """(layout, ord, name, type, postprocess, pattern, custom_pattern, options, lexicon): fields as text for a table to edit."""
    pattern = F.coalesce("pattern", F.lit(""))
    named = _choice(pattern, {p: n for n, p in NAMED_PATTERNS.items()}, F.when(pattern == "", "").otherwise(CUSTOM))
    shown = _choice(F.col("type"), {t: u for u, t in TABLE_TYPES.items()}, F.lit("short"))
    options = F.coalesce(F.array_join(F.transform("options", lambda o: o["name"]), " | "), F.lit(""))
    return fields.select("layout", "ord", F.col("field").alias("name"), shown.alias("type"), effective_rule().alias("postprocess"), named.alias("pattern"), F.when(named == CUSTOM, pattern).otherwise("").alias("custom_pattern"), options.alias("options"), F.coalesce("lexicon", F.lit("")).alias("lexicon"))


def read_field_tables(spark: SparkSession, path: str) -> DataFrame:
    """Saved field tables (JSON lines or arrays): unknown columns dropped, missing values empty."""
    names = ("layout", "name", "type", "postprocess", "pattern", "custom_pattern", "options", "lexicon")
    return spark.read.schema("ord int, " + ", ".join(f"{n} string" for n in names)).option("multiLine", True).json(path).na.fill("")


def judged(rows: DataFrame) -> DataFrame:
    """Edited rows as fields (layout, ord, field, type, rule, pattern, lexicon, options array<string>) with ``problems``, ``notices`` and ``taken``.

    ``rows`` as of ``field_table``; null is empty. Problems forbid the use of the layout,
    notices say what was cleared because it does not apply to the type. ``taken`` is
    false for rows that make no field: without a name, with a name that an earlier row
    has, of unknown type or rule. A pattern choice that is none of the known ones is a
    pattern itself. Patterns are compiled where they are used, not here.
    """
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    earlier = F.row_number().over(Window.partitionBy("layout", "name").orderBy("ord")) > 1
    rows = rows.withColumn("name", cell("name")).withColumn("_again", earlier & (F.col("name") != ""))
    shown = _choice(cell("type"), OLD_TABLE_TYPES, cell("type"))
    chosen = cell("pattern")
    pattern = _choice(chosen, NAMED_PATTERNS, F.when(chosen == CUSTOM, cell("custom_pattern")).otherwise(chosen))
    rule = F.when(cell("postprocess") == "", "none").otherwise(cell("postprocess"))
    options = F.filter(F.transform(F.split(F.coalesce("options", F.lit("")), r"\|"), lambda o: F.trim(o)), lambda o: o != "")
    raw = rows.select("layout", "ord", F.col("name").alias("field"), "_again", shown.alias("_shown"), rule.alias("_rule"), pattern.alias("_pattern"), cell("lexicon").alias("_lexicon"), options.alias("_options"))

    blocked = F.when(F.col("field") == "", "row without a field name").when(F.col("_again"), "name used twice").when(~F.col("_shown").isin(*TABLE_TYPES), "unknown type").when(~F.col("_rule").isin(*RULES), "unknown rule")
    bare = F.col("_shown").isin("checkbox", "ignore")
    notices = [(bare & (F.col("_rule") != "none"), "rule does not apply"), (bare & (F.col("_pattern") != ""), "pattern does not apply"), (bare & (F.col("_lexicon") != ""), "lexicon does not apply"), ((F.col("_shown") != "checkbox") & (F.size("_options") > 0), "options do not apply")]
    rule = F.when(bare, "none").otherwise(F.col("_rule"))
    pattern = F.when(bare, "").otherwise(F.col("_pattern"))
    lexicon = F.when(bare, "").otherwise(F.col("_lexicon"))
    missing = [(rule == "numeric") & (pattern == ""), (rule == "lexicon") & (lexicon == "")]
    list_of = lambda *whens: F.array_compact(F.array(*whens)).cast("array<string>")
    none = F.array().cast("array<string>")
    kind = F.when((F.col("_shown") == "short") & (pattern != ""), "number").otherwise(_choice(F.col("_shown"), TABLE_TYPES, F.lit(None).cast("string")))
    taken = raw.withColumn("_blocked", blocked)
    free = F.col("_blocked").isNull()
    return taken.select(
        "layout", "ord", "field", kind.alias("type"), rule.alias("rule"), F.nullif(pattern, F.lit("")).alias("pattern"), F.nullif(lexicon, F.lit("")).alias("lexicon"),
        F.when(F.col("_shown") == "checkbox", F.col("_options")).otherwise(none).alias("options"),
        F.when(free, list_of(F.when(missing[0], "numeric rule needs a pattern"), F.when(missing[1], "lexicon rule needs a lexicon"))).otherwise(list_of("_blocked")).alias("problems"),
        F.when(free, list_of(*[F.when(t, told) for t, told in notices])).otherwise(none).alias("notices"),
        free.alias("taken"),
    )


def with_schema(fields: DataFrame, schema: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Layouts with their fields' meaning replaced, and what forbids it: (fields, problems).

    ``schema``: (layout, ord, field, type, rule, pattern, lexicon, options array<string>),
    names once a layout; nulls keep what the layout has, empty options too. Boxes and options
    stay with the layout; options go where a field is no checkbox group any more. The order
    is the schema's, then that of fields it does not name. Problems (layout, field,
    problem): a field not in the layout; with ``strict`` one missing from the schema;
    other options than the layout's. A layout with a problem has no rows in the result.
    """
    new = schema.select(*[F.col(c).alias(f"_{c}") for c in ("layout", "ord", "field", "type", "rule", "pattern", "lexicon", "options")])
    met = fields.join(new, (F.col("layout") == F.col("_layout")) & (F.col("field") == F.col("_field")), "full_outer")
    other = (F.size("_options") > 0) & (F.col("_options") != F.transform("options", lambda o: o["name"]))
    problem = F.when(F.col("layout").isNull(), "not in the layout").when(F.col("_layout").isNull() & F.lit(strict), "missing from the schema").when(F.coalesce(other, F.lit(False)), "options are the layout's")
    met = met.withColumn("problem", problem).withColumn("at", F.coalesce("layout", "_layout"))
    problems = met.filter("problem is not null").select(F.col("at").alias("layout"), F.coalesce("field", "_field").alias("field"), "problem")
    fine = met.join(problems.select(F.col("layout").alias("at")).distinct(), "at", "left_anti")
    own = lambda c: F.coalesce(f"_{c}", c).alias(c)
    order = F.row_number().over(Window.partitionBy("layout").orderBy(F.col("_ord").isNull(), "_ord", "ord")) - 1
    kept = F.when(F.coalesce("_type", "type") == "checkbox_group", F.col("options")).otherwise(F.array().cast(_OPTIONS))
    return fine.select("layout", order.alias("ord"), "field", own("type"), own("rule"), own("pattern"), own("lexicon"), kept.alias("options"), "roi", "labels", "note"), problems


def from_boxes(boxes: DataFrame) -> DataFrame:
    """Fields of drawn boxes (layout, ord, field, roi, type): a null type is ``text``."""
    null = F.lit(None).cast("string")
    return boxes.select("layout", "ord", "field", F.coalesce("type", F.lit("text")).alias("type"), null.alias("rule"), null.alias("pattern"), null.alias("lexicon"), F.array().cast(_OPTIONS).alias("options"), "roi", F.array().cast("array<string>").alias("labels"), null.alias("note"))


def whole_page(schema: DataFrame) -> DataFrame:
    """Fields of a schema (as of ``judged``) without measured geometry: each box is the page, options stand side by side.

    The boxes only hold a place; nothing is cropped by them. A checkbox group of fewer than two options shows in ``broken_rules``.
    """
    n = F.size("options")
    side = F.transform("options", lambda o, i: F.struct(o.alias("name"), F.array(i / n + 0.01, F.lit(0.05), (i + 1) / n - 0.01, F.lit(0.95)).alias("box")))
    options = F.when(F.col("type") == "checkbox_group", side).otherwise(F.array().cast(_OPTIONS))
    return schema.select("layout", "ord", "field", "type", "rule", "pattern", "lexicon", options.alias("options"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("roi"), F.array().cast("array<string>").alias("labels"), F.lit("placeholder box").alias("note"))


def assembled(schema: DataFrame, source: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Fields of a schema with what ``source`` measured for fields of the same name; boxes are never invented.

    Without measured options a field keeps the schema's option names, without boxes. ``labels``: (layout, field, ord, label).
    """
    here = source.select(F.col("layout").alias("_l"), F.col("field").alias("_f"), F.col("roi").alias("_roi"), F.col("options").alias("_o"))
    met = schema.join(here, (F.col("layout") == F.col("_l")) & (F.col("field") == F.col("_f")), "left")
    spoken = F.array().cast("array<string>")
    if labels is not None:
        listed = labels.groupBy(F.col("layout").alias("_ll"), F.col("field").alias("_lf")).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("_labels"))
        met = met.join(listed, (F.col("layout") == F.col("_ll")) & (F.col("field") == F.col("_lf")), "left")
        spoken = F.coalesce(F.transform("_labels", lambda x: x["label"]), spoken)
    names = F.transform("options", lambda o: F.struct(o.alias("name"), F.lit(None).cast("array<double>").alias("box")))
    return met.select("layout", "ord", "field", "type", F.nullif("rule", F.lit("none")).alias("rule"), "pattern", "lexicon", F.when(F.size("_o") > 0, F.col("_o")).otherwise(names).alias("options"), F.col("_roi").alias("roi"), spoken.alias("labels"), F.lit(None).cast("string").alias("note"))


def idle_rules(fields: DataFrame, entries: DataFrame, n_domains: int, has_model: bool) -> DataFrame:
    """(layout, field, problem): rules that would change nothing for want of what they need.

    ``entries``: (lexicon, entry), the lexicons at hand.
    """
    known = entries.filter("entry is not null").select(F.col("lexicon").alias("_lexicon")).distinct()
    met = fields.join(known, F.col("lexicon") == F.col("_lexicon"), "left")
    rule = effective_rule()
    problem = (
        F.when((rule == "lexicon") & F.col("_lexicon").isNull(), "lexicon is empty or missing")
        .when((rule == "email") & F.lit(n_domains == 0), "no e-mail domains")
        .when((rule == "llm") & F.lit(not has_model), "no language model")
        .when((rule == "numeric") & (F.coalesce("pattern", F.lit("")) == ""), "numeric rule without a pattern")
    )
    return met.select("layout", "field", problem.alias("problem")).filter("problem is not null")
