"""Configuration files, id lists, resources and plausibility on small cases."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from formlake.functions import dates
from formlake.operators import flags
from formlake.sources import configurations as K
from formlake.sources import lists

FORM = {
    "layout": "a", "coordinate_space": "relative", "stop_labels": ["Ende"], "_comment": ["x"],
    "fields": [
        {"name": "n", "type": "text", "roi": [0, 0, 1, 0.5], "label": "Name", "postprocess": "name", "unknown": 1},
        {"name": "g", "type": "checkbox_group", "roi": None, "options": ["zwei", "eins"], "label": ["G", "Gruppe"]},
        {"name": "h", "type": "checkbox_group", "roi": [0, 0, 1, 1], "options": {"z": [0, 0, 0.4, 1], "a": [0.5, 0, 1, 1]}},
    ],
}


@pytest.fixture()
def forms(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(FORM, indent=2))
    (tmp_path / "plain.json").write_text(json.dumps({"fields": [{"name": "f", "type": "number", "roi": [1, 1, 2, 2], "pattern": "\\d+"}]}))
    (tmp_path / "none.json").write_text(json.dumps({"layout": "none", "fields": []}))
    return K.read_configurations(spark, str(tmp_path))


def test_files_are_read(forms):
    listed = {r["layout"]: tuple(r)[1:] for r in K.listing(forms).collect()}
    assert listed == {"a": (3, False), "plain": (1, True), "none": (0, False)}
    rows = {r["field"]: r for r in K.fields_of(forms).collect()}
    assert [o["name"] for o in rows["g"]["options"]] == ["zwei", "eins"] and rows["g"]["options"][0]["box"] is None
    assert [o["name"] for o in rows["h"]["options"]] == ["z", "a"] and rows["h"]["options"][1]["box"] == [0.5, 0.0, 1.0, 1.0]
    assert rows["n"]["labels"] == ["Name"] and rows["g"]["labels"] == ["G", "Gruppe"] and rows["f"]["labels"] == []
    assert [(r["field"], r["ord"], r["label"]) for r in K.labels_of(K.fields_of(forms)).orderBy("field", "ord").collect()] == [("g", 0, "G"), ("g", 1, "Gruppe"), ("n", 0, "Name")]
    assert {r["layout"]: r["stop_labels"] for r in forms.collect()}["a"] == ["Ende"]
    assert K.broken_rules(K.fields_of(forms), relative=False).count() == 0
    assert [(r["field"], r["problem"]) for r in K.broken_rules(K.fields_of(forms), relative=True).collect()] == [("f", "box beyond the page")]


def test_files_are_written(spark, forms):
    stops = spark.createDataFrame([("a", 1, "Schluss"), ("a", 0, "Ende")], "layout string, ord int, label string")
    fields = K.fields_of(forms)
    out = {r["layout"]: json.loads(r["document"]) for r in K.documents(fields, "relative", stops).collect()}
    assert out["a"]["stop_labels"] == ["Ende", "Schluss"] and "stop_labels" not in out["plain"]
    n, g, h = out["a"]["fields"]
    assert n == {"name": "n", "type": "text", "roi": [0, 0, 1, 0.5], "postprocess": "name", "label": "Name"}
    assert g == {"name": "g", "type": "checkbox_group", "roi": None, "options": ["zwei", "eins"], "label": ["G", "Gruppe"]}
    assert list(h["options"]) == ["z", "a"] and h["options"]["z"] == [0, 0, 0.4, 1]
    again = K.fields_of(K.parsed(K.documents(fields)))
    assert sorted(map(str, again.collect())) == sorted(map(str, fields.collect()))


def test_assembled_never_invents_boxes(spark, forms):
    schema = spark.createDataFrame([("a", 0, "n", "text", "none", None, None, []), ("a", 1, "new", "checkbox_group", "none", None, None, ["x", "y"]), ("a", 2, "h", "checkbox_group", "none", None, None, ["p", "q"])], "layout string, ord int, field string, type string, rule string, pattern string, lexicon string, options array<string>")
    labels = spark.createDataFrame([("a", "new", 0, "Neu")], "layout string, field string, ord int, label string")
    rows = {r["field"]: r for r in K.assembled(schema, K.fields_of(forms), labels).collect()}
    assert rows["new"]["roi"] is None and rows["new"]["labels"] == ["Neu"] and [o["box"] for o in rows["new"]["options"]] == [None, None]
    assert rows["n"]["roi"] == [0, 0, 1, 0.5] and rows["n"]["rule"] is None
    assert [o["name"] for o in rows["h"]["options"]] == ["z", "a"]


def test_schema_applies_whole_or_not_at_all(spark, forms):
    new = "layout string, ord int, field string, type string, rule string, pattern string, lexicon string, options array<string>"
    fields = K.fields_of(forms)
    full = [("a", 0, "h", "text", None, None, None, []), ("a", 1, "g", None, None, None, None, ["zwei", "eins"]), ("a", 2, "n", "text", "date", None, None, None), ("plain", 0, "f", None, None, None, None, None)]
    applied, problems = K.with_schema(fields, spark.createDataFrame(full, new))
    assert problems.count() == 0
    rows = [tuple(r) for r in applied.orderBy("layout", "ord").select("layout", "field", "type", "rule", F.size("options")).collect()]
    assert rows == [("a", "h", "text", None, 0), ("a", "g", "checkbox_group", None, 2), ("a", "n", "text", "date", 0), ("plain", "f", "number", None, 0)]
    part = spark.createDataFrame([("a", 0, "g", None, None, None, None, None), ("plain", 0, "x", "text", None, None, None, None)], new)
    applied, problems = K.with_schema(fields, part)
    assert applied.count() == 0 and sorted((r["field"], r["problem"]) for r in problems.collect()) == [("f", "missing from the schema"), ("h", "missing from the schema"), ("n", "missing from the schema"), ("x", "not in the layout")]
    applied, problems = K.with_schema(fields, part, strict=False)
    assert [r["field"] for r in applied.orderBy("ord").collect()] == ["g", "n", "h"] and [r["field"] for r in problems.collect()] == ["x"]


def test_judged_rows(spark):
    names = ("layout", "ord", "name", "type", "postprocess", "pattern", "custom_pattern", "options", "lexicon")
    rows = [
        ("a", 0, " plz ", "text/number", "numeric", "postal code (exactly 5 digits)", None, None, None),
        ("a", 1, "box", "checkbox", "name", r"\d", None, "x | y |", "l"),
        ("a", 2, "own", "short", None, K.CUSTOM, r"^a$", "x", None),
        ("a", 3, "own", "long", None, None, None, None, None),
        ("a", 4, None, "long", None, None, None, None, None),
        ("a", 5, "city", "short", "lexicon", "", "", "", " "),
        ("a", 6, "odd", "short", "magic", None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'ord' else 'string'}" for n in names))
    got = {r["ord"]: r for r in K.judged(frame).collect()}
    assert (got[0]["field"], got[0]["type"], got[0]["pattern"], got[0]["problems"]) == ("plz", "number", r"^\d{5}$", [])
    assert got[1]["options"] == ["x", "y"] and len(got[1]["notices"]) == 3 and got[1]["rule"] == "none" and got[1]["lexicon"] is None
    assert got[2]["pattern"] == "^a$" and got[2]["notices"] == ["options do not apply"]
    assert [got[k]["problems"] for k in (3, 4, 5, 6)] == [["name used twice"], ["row without a field name"], ["lexicon rule needs a lexicon"], ["unknown rule"]]
    assert [got[k]["taken"] for k in range(7)] == [True, True, True, False, False, True, False]


def test_drawn_and_placeholder_boxes(spark):
    drawn = spark.createDataFrame([("a", 0, "x", [0.0, 0.0, 5.0, 5.0], None), ("a", 1, "y", [3.0, 0.0, 3.0, 5.0], "number")], "layout string, ord int, field string, roi array<double>, type string")
    fields = K.from_boxes(drawn)
    assert [r["type"] for r in fields.orderBy("ord").collect()] == ["text", "number"]
    assert sorted(r["problem"] for r in K.broken_rules(fields).collect()) == ["empty box", "numeric rule without a pattern"]


def test_id_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"test": [3, "007", "a-1"], "train": [1]}))
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": 12, "text": "t"}, {"doc_id": "b"}]))
    ids = lists.read_split_ids(spark, str(tmp_path / "s.json"), "test")
    assert [tuple(r) for r in lists.in_document_order(ids).collect()] == [(3, None), (7, None), (None, "a-1")]
    assert [tuple(r) for r in lists.in_document_order(ids, 1).collect()] == [(3, None)]
    with pytest.raises(KeyError):
        lists.read_split_ids(spark, str(tmp_path / "s.json"), "valid")
    assert sorted(map(str, map(tuple, lists.read_manifest_ids(spark, str(tmp_path / "m.json")).collect()))) == ["(12, None)", "(None, 'b')"]
    paths = spark.createDataFrame([("/x/page_3.png",), ("/x/page_7.png",), ("/7/y.png",)], "path string")
    with pytest.raises(ValueError, match="a-1"):
        lists.in_files(paths, ids)
    assert [r["path"] for r in lists.in_files(paths, ids.filter("doc_key is null")).orderBy("path").collect()] == ["/x/page_3.png", "/x/page_7.png"]


def test_lexicons_of_a_folder(spark, tmp_path):
    (tmp_path / "city.txt").write_text("# towns\nUlm\n Ulm \n\nBonn\n")
    (tmp_path / "empty.txt").write_text("# none\n")
    entries = lists.read_lexicons(spark, str(tmp_path))
    assert [tuple(r) for r in lists.lexicon_sizes(entries).collect()] == [("city", 2)]
    fields = K.from_boxes(spark.createDataFrame([("a", k, f, [0.0, 0.0, 1.0, 1.0], "text") for k, f in enumerate("cem")], "layout string, ord int, field string, roi array<double>, type string"))
    fields = fields.withColumns({"rule": F.when(F.col("field") == "m", "email").otherwise("lexicon"), "lexicon": F.when(F.col("field") == "c", "city").when(F.col("field") == "e", "empty")})
    assert sorted(tuple(r) for r in K.idle_rules(fields, entries, 0, True).collect()) == [("a", "e", "lexicon is empty or missing"), ("a", "m", "no e-mail domains")]


def test_dates_of_values(spark):
    told = {"1.2.03": date(2003, 2, 1), "1 . 2 / 1999": date(1999, 2, 1), "3. März 1990": date(1990, 3, 3), "3. Maerz 1990": None, "3. Marz 1990": None, "30.2.1990": None, "": None, "x": None, "1.1.123": date(123, 1, 1)}
    fine = {"3. Marz 1990": True, "3. Maerz 1990": True, "3. Xyzuv 1990": False, "1.2.03": True, "30.2.1990": False, "l. Mai 1990": False, "1 . 2 / 1999": True}
    df = spark.createDataFrame([(k,) for k in {**told, **fine}], "v string").select("v", dates.value_date(F.col("v")).alias("d"), dates.birth_date_shape(F.col("v")).alias("ok"))
    rows = {r["v"]: r for r in df.collect()}
    assert {k: rows[k]["d"] for k in told} == told
    assert {k: rows[k]["ok"] for k in fine} == fine


def test_plausibility_cases(spark):
    fields = spark.createDataFrame([("d", "number", "date", None, None), ("g", "checkbox_group", None, None, ["x"]), ("n", "number", None, r"\d+", None)], "field string, type string, rule string, pattern string, options array<string>")
    cells = spark.createDataFrame([(1, "d", "1.1.1926"), (2, "d", "2.1.1926"), (3, "d", None), (1, "g", "y"), (2, "g", "y"), (3, "g", ""), (1, "n", "7x"), (2, "n", "x7"), (1, "other", "?")], "doc_id int, field string, value string")
    today = F.lit("2026-01-01").cast("date")
    status = spark.createDataFrame([(2, "g", "ok"), (3, "g", "ambiguous")], "doc_id int, field string, status string")
    got = [tuple(r) for r in flags.plausibility(cells, fields, today, status).collect()]
    assert got == [(1, "d", "age is 100 years or more"), (1, "g", "checkbox: no such option: y"), (2, "n", "not in the number's format"), (3, "g", "checkbox: ambiguous")]
    scores = spark.createDataFrame([(1, "d", float("nan")), (2, "d", 0.5), (2, "n", 0.9)], "doc_id int, field string, conf_min double")
    two = cells.filter("field in ('d', 'n')")
    got = {(r[0], r[1]): r[2] for r in flags.plausibility(two, fields, today, confidences=scores, reviewed=spark.createDataFrame([(3, "d")], "doc_id int, field string")).collect()}
    assert got == {(1, "d"): "age is 100 years or more; no confidence", (2, "d"): "low confidence (0.50 < 0.75)", (1, "n"): "no confidence", (2, "n"): "not in the number's format"}
    assert flags.plausibility(cells.limit(0), fields, today).count() == 0
