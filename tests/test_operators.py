import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlake.functions import dates, geometry, json_fields, text
from formlake.operators import cells, closest_pairs, flags, guardrail, markup, matching, ordered, rules, vision
from formlake.sources import layouts, lists, text_csv
from formlake.streaming import ingest


def values(spark, column, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_numeric_rule(spark):
    fix = lambda v: rules.numeric(v, "[0-9]{5}$")
    assert values(spark, fix, ["86Zro", "02125", "8A123", "", None]) == ["86250", "02125", "8A123", "", None]


def test_date_rule(spark):
    given = ["3l.12.1999", "31.02.1999", "1 2.3.2001", "29.2.2000", "29.2.1900", "3. Marz 1990", "31. April 1990", "", None]
    assert values(spark, rules.date, given) == ["31.12.1999", "31.02.1999", "12.3.2001", "29.2.2000", "29.2.1900", "3. März 1990", "31. April 1990", "", None]


def test_name_email_and_street_rules(spark):
    assert values(spark, rules.name, ["Mu11er", "anne-marie", "A3nna", " "]) == ["Muiier", "Anne-Marie", "Anna", " "]
    assert values(spark, lambda v: rules.email(v, ["example.com"]), ["A@Exampel.com", "No At", "a@b@exanple.com"]) == ["a@example.com", "noat", "a@b@example.com"]
    given = ["Hauptstrabe", "Anna-Meyer-Weq", "Höfigstr.", "Weg", ""]
    assert values(spark, lambda v: rules.street_suffix(v, ["straße", "str.", "weg"]), given) == ["Hauptstraße", "Anna-Meyer-Weg", "Höfigstr.", "weg", ""]


def test_lexicon_rule_keeps_members_and_far_values(spark):
    listed = spark.createDataFrame([("Berlin", 1), ("München", 2)], "entry string, ord int")
    rows = spark.createDataFrame([(1, "Munchen"), (2, "Berlin"), (3, "Xyz"), (4, None)], "k int, value string")
    assert dict(rules.lexicon(rows, listed).select("k", "value").collect()) == {1: "München", 2: "Berlin", 3: "Xyz", 4: None}


@pytest.mark.parametrize("rule, given", [("numeric", ["86Zro", "x"]), ("date", ["3l.12.1999", "3. Marz 1990"]), ("name", ["Mu11er", "anne-marie"])])
def test_rules_are_idempotent(spark, rule, given):
    f = (lambda v: rules.numeric(v, "[0-9]{5}$")) if rule == "numeric" else rules.RULES[rule]
    once = values(spark, f, given)
    assert values(spark, f, once) == once


def test_guardrail(spark):
    cases = [
        ("das ist ein tset", "das ist ein test", {}, True),
        ("gutn tag", "guten tag", {}, True),
        ("Gutn tgg", "guten Tag", {}, True),
        ("wirmeine das so", "wir meine das so", {}, False),
        ("wirmeine das so wie du", "wir meine das so wie du", {"word_splits": True}, True),
        ("a b c d", "a b XXXXXXXX c d", {}, True),
        ("a b c", "x y z q r s t", {}, False),
        ("eins zwei drei", "einen zwein dreien", {}, False),
        ("das haus", "das pferd", {}, False),
        ("a", "", {}, False),
        ("a", None, {}, False),
        (None, "neu", {}, True),
        ("", " ", {}, False),
    ]
    for limits in ({}, {"word_splits": True}):
        own = [(k, a, b) for k, (a, b, l, _) in enumerate(cases) if l == limits]
        rows = spark.createDataFrame(own, "k int, a string, b string")
        for r in rows.select("*", guardrail.corrected(F.col("a"), F.col("b"), **limits).alias("value")).collect():
            assert r["value"] == (r["b"] if cases[r["k"]][3] else r["a"] or ""), cases[r["k"]]
    rows = spark.createDataFrame([("gutn tag", " \"'guten tag.'\" "), ("gutn tag.", "guten tag.")], "a string, b string")
    assert [r[0] for r in rows.select(guardrail.corrected(F.col("a"), F.col("b"))).collect()] == ["guten tag", "guten tag."]


def test_text_functions(spark):
    assert values(spark, text.slug, ["--A b_c!", "ä"]) == ["A-b-c", ""]
    assert values(spark, text.document_number, ["form_12_page07", "none"]) == [7, None]
    assert values(spark, text.capitalised, ["anna-MARIA von x"]) == ["Anna-Maria Von X"]
    assert values(spark, lambda v: text.html_lines(v), ["<p>a <b>b</b></p>c<br>d<script>no</script>"]) == [["a b", "c", "d"]]
    assert values(spark, lambda v: json_fields.fields_of(v)["k"], ['x {"k": 09252, "n": null} y', '{"k": "a"}', "none"]) == ["09252", "a", None]


def test_ages(spark):
    today = F.lit("2024-05-01").cast("date")
    assert values(spark, lambda v: dates.age_reason(v.cast("date"), today), ["2085-01-01", "1924-05-01", "1924-05-02"]) == ["date lies in the future", "age is 100 years or more", None]


def test_geometry(spark):
    df = spark.createDataFrame([(2.5, 3.5)], "a double, b double")
    low, high = geometry.clipped(F.col("b"), F.col("a"), F.lit(10))
    assert tuple(df.select(low, high).first()) == (2, 4)


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("1", "007", ' "q"\nx, '), ("2", "", None)], "doc_id string, a string, b string")
    text_csv.write_text_csv(df, str(tmp_path / "t"), "doc_id")
    back = text_csv.with_integer_key(text_csv.read_text_csv(spark, str(tmp_path / "t"), df.columns), "doc_id")
    assert sorted(map(tuple, back.collect())) == [(1, "007", ' "q"\nx, '), (2, "", "")]
    with pytest.raises(TypeError):
        text_csv.write_text_csv(df.withColumn("a", F.lit(7)), str(tmp_path / "u"), "doc_id")


def test_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\nweg\n\nplatz\nweg\nallee\n")
    assert [tuple(r) for r in lists.read_ordered_list(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == [("weg", 1), ("platz", 2), ("allee", 3)]
    (tmp_path / "l.csv").write_text("id,name\n1, b\n2,a\n3,b\n")
    assert [r["entry"] for r in lists.read_lexicon_csv(spark, str(tmp_path / "l.csv")).orderBy("ord").collect()] == ["a", "b"]


def test_layouts(tmp_path):
    good = {"fields": [{"name": "a", "type": "text", "roi": [0, 0, 1, 1]}]}
    (tmp_path / "l.json").write_text(json.dumps(good))
    assert layouts.read_layout(str(tmp_path / "l.json")) == good["fields"]
    for bad in ([{"name": "a", "type": "x"}], [{"name": "a", "type": "text"}] * 2, [{"name": "a", "type": "text", "roi": [1, 0, 1, 1]}], [{"name": "a", "type": "text", "options": {"b": []}}]):
        with pytest.raises(ValueError):
            layouts.checked({"fields": bad})


def test_cells_round_trip(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b")], "k int, x string, y string")
    wide = cells.to_wide(cells.to_cells(df, "k", ["x", "y"]), "k", ["x", "y"])
    assert sorted(map(tuple, wide.collect())) == [(1, "a", ""), (2, "", "b")]
    reasons = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, ord int, reason string")
    assert cells.joined_reasons(reasons, ["k"]).first()["reason"] == "a; b"


def parse(spark, pages, labels):
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id long, raw string")
    out = markup.field_values(markup.segments(df), markup.label_specs(spark, labels))
    return {(r["doc_id"], r["field"]): (r["value"], r["strategy"]) for r in out.collect()}


def test_markup_strategies(spark):
    labels = {"name": ["Name"], "city": ["Ort", "Wohnort"], "zip": ["PLZ"]}
    pages = [
        "<table><tr><td>Name</td><td></td><td>Anna</td></tr><tr><td>Ort: Ulm</td></tr></table>",
        "<table><tr><th>Name</th><th>PLZ</th></tr><tr><td>Bo</td><td>02125</td></tr></table>",
        "<|ref|>a<|/ref|><|det|>[[0,0,50,20]]<|/det|>Name\n<|ref|>b<|/ref|><|det|>[[0,40,50,60]]<|/det|>Ort\n<|ref|>c<|/ref|><|det|>[[60,1,90,19]]<|/det|>Cleo\n<|ref|>d<|/ref|><|det|>[[60,41,90,59]]<|/det|>Bonn\n",
        "Name\nDora\nOrt Wien",
        "| Name | Emil |\n|---|---|\n| PLZ | 1 |",
        "",
        None,
        "<p>Name</p><p><input type=text value='0077'></p><p>Ortsteil</p>",
    ]
    got = parse(spark, pages, labels)
    assert got[0, "name"] == ("Anna", "grid") and got[0, "city"] == ("Ulm", "inline") and got[0, "zip"] == ("", None)
    assert got[1, "name"] == ("Bo", "grid") and got[1, "zip"] == ("02125", "grid")
    assert got[2, "name"] == ("Cleo", "geometric") and got[2, "city"] == ("Bonn", "geometric")
    assert got[3, "name"] == ("Dora", "sequential") and got[3, "city"] == ("Wien", "inline")
    assert got[4, "name"] == ("Emil", "grid") and got[4, "zip"] == ("1", "grid")
    assert got[7, "name"] == ("0077", "sequential") and got[7, "city"] == ("", None)
    assert {k for k, _ in got} == {0, 1, 2, 3, 4, 7}


def test_spans_deletions_and_objects():
    cells_ = markup.page_segments("<table><tr><td colspan=3>a</td><td>b</td></tr><tr><td rowspan=2>c</td><td>d</td></tr><tr><td>e</td></tr></table>")
    assert [(t, r, c) for t, _, _, r, c, _ in cells_] == [("a", 0, 0), ("b", 0, 3), ("c", 1, 0), ("d", 1, 1), ("e", 2, 1)]
    assert [x[0] for x in markup.page_segments("<p>new <del>old</del></p><p><del>only</del></p>")] == ["new", "only"]
    assert markup.balanced_objects('a {"x": {"y": 1}} b {c} }') == ['{"x": {"y": 1}}', "{c}"]


def test_joins_and_order(spark):
    spans = spark.createDataFrame([(1, "f", 2, 5), (1, "g", 50, 60)], "doc_id int, field string, s int, e int")
    tokens = spark.createDataFrame([(1, k, 2 * k, 2 * k + 2, -0.5 * k) for k in range(6)], "doc_id int, pos int, ts int, te int, logp double")
    got = {r["field"]: r for r in flags.span_confidence(spans, tokens).collect()}
    assert got["f"]["n_tokens"] == 2 and got["f"]["conf_first"] == pytest.approx(np.exp(-0.5)) and got["g"]["conf_min"] is None
    profile = spark.createDataFrame([(1, [1.0, 3.0, 3.0, 1.0, 2.0])], "k int, p array<double>")
    assert profile.select(ordered.local_maxima(F.col("p"))).first()[0] == [2, 4]
    assert profile.select(ordered.moving_average(F.col("p"), 3)).first()[0] == pytest.approx([5 / 3, 7 / 3, 7 / 3, 2, 5 / 3])
    entries = spark.createDataFrame([("abcd", 2), ("abce", 1)], "entry string, ord int")
    near = matching.nearest_entries(spark.createDataFrame([("abcx",), ("zz",), ("abcd",)], "value string"), entries, 0.34)
    assert sorted(map(tuple, near.collect())) == [("abcd", "abcd", 0), ("abcx", "abce", 1)]


def png(path, pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_crop_path(spark, tmp_path):
    page = np.full((60, 40), 255, np.uint8)
    page[10:20, 5:30] = 0
    page[35:45, 5:30] = 0
    png(tmp_path / "form_07.png", page)
    pages = vision.read_pages(spark, str(tmp_path))
    rois = spark.createDataFrame([("top", 0, 0, 40, 30), ("none", 50, 0, 60, 9)], "field string, x1 int, y1 int, x2 int, y2 int")
    out = vision.recognised(vision.crops(pages, rois), lambda: lambda images: [str(int((i < 128).sum())) for i in images])
    assert sorted(map(tuple, out.collect())) == [(7, "none", ""), (7, "top", "250")]
    assert vision.line_bands(page) == [(8, 22), (33, 47)] and vision.line_bands(np.full((5, 5), 255, np.uint8)) == []
    assert vision.crop_to_text(page).shape == (45, 35) and vision.median_blur(page).shape == page.shape
    assert 0 <= vision.otsu_level(page) < 255


def test_ingest_parses_each_page_once(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "Name: A")], ingest.RAW).write.json(landing)
    assert ingest.parse_new_pages(spark, landing, out, mark) == 1
    spark.createDataFrame([(2, "<p>x</p><p>y</p>")], ingest.RAW).write.mode("append").json(landing)
    assert ingest.parse_new_pages(spark, landing, out, mark) == 1
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["Name: A", "x", "y"]


def test_texts_as_people_write_them(spark):
    from formlake.functions import dates, geometry, text

    def run(f, values):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r["o"] for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]

    assert run(text.clean_text, ["\\[ 68496 \\]", "## a_b `c`\nd", "*x* __y__  z\t", "<math>\\(5\\)</math>", None, "a" + text.STOP_SIGN, "$7"]) == ["68496", "a_b `c`\nd", "x y z", "5", None, "a", "$7"]
    assert run(text.clean_value, [": – Müller |", "[x]", "☐ ☒", "x", None, "", "a.b:"]) == ["Müller", "", "", "x", None, "", "a.b"]
    spelled = ["5. Mai 98", "5.Mai1998", "3. Marz 1990", "31. April 1990", " 1 maerz 2001 ", "l2. Jvni 2O04", "no date", None]
    assert run(dates.corrected_spelled_date, spelled) == ["5. Mai 98", "5. Mai 1998", "3. März 1990", None, "1. März 2001", "12. Juni 2004", None, None]
    assert run(lambda c: geometry.folded_angle(c.cast("int")), ["45", "-45", "90", "46", "134", "-10"]) == [45, 45, 0, -44, 44, -10]
    boxes = spark.createDataFrame([(0.0, 0.5, 0.2, 0.6), (0.0, 1.0, 1.0, 2.0), (0.0, 4.0, 2.0, 2.0)], "a double, b double, c double, d double")
    shares = [round(r[0], 6) for r in boxes.select(geometry.overlap_share(*[F.col(c) for c in "abcd"])).collect()]
    assert shares == [0.75, 0.0, 0.0]
    ends = spark.createDataFrame([("a", "a."), ("a?", "a!"), (None, "b ?"), ("a", "")], "o string, c string")
    assert [r[0] for r in ends.select(text.without_added_end(F.col("o"), F.col("c"))).collect()] == ["a", "a!", "b", ""]


def test_labels_inside_a_line(spark):
    names = {"name": ["Name", "Name of child"], "city": ["City"], "street": ["Street"]}
    pages = [(1, "Name of child: A b City: B\nCity: later"), (2, "Name: City: B"), (3, "Old City: x"), (4, "  name : Street Citymap City : C\nplain"), (5, None), (6, "")]
    parts = markup.split_at_labels(markup.segments(spark.createDataFrame(pages, "doc_id long, raw string")), names)
    assert sorted((r["doc_id"], r["ord"], r["text"]) for r in parts.collect()) == [
        (1, 0, "Name of child: A b"), (1, 1, "City: B"), (1, 2, "City: later"),
        (2, 0, "Name:"), (2, 1, "City: B"),
        (3, 0, "Old City: x"),
        (4, 0, "name : Street Citymap"), (4, 1, "City : C"), (4, 2, "plain"),
    ]
    got = {(r["doc_id"], r["field"]): r["value"] for r in markup.field_values(parts, markup.label_specs(spark, names)).collect()}
    assert got[1, "name"] == "A b" and got[1, "city"] == "B" and got[2, "name"] == "" and got[2, "city"] == "B"
    assert got[3, "city"] == "" and got[4, "name"] == "Street Citymap" and got[4, "city"] == "C" and got[4, "street"] == ""


def test_closest_pairs_in_blocks(spark, monkeypatch):
    """All pairs by brute force: copies, missing components, several blocks of a key, no key."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, [float(x) for x in rng.integers(0, 4, 5)]) for k in range(90)]
    rows += [(100, 0, None), (101, 1, [1.0, None, 2.0, 0.0, 1.0]), (102, 1, [2.0, 1.0]), (103, 0, [float("nan")] * 5), (104, None, [1.0] * 5), (105, 0, [])]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")

    def distance(x, y):
        both = [(p, q) for p, q in zip(x or [], y or []) if p is not None and q is not None]
        return math.sqrt(sum((p - q) ** 2 for p, q in both)) if both else None

    told = [(a[0], b[0], distance(a[2], b[2])) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1]]
    place = lambda p: (p[2] is None, p[2] is not None and math.isnan(p[2]), 0 if p[2] is None or math.isnan(p[2]) else round(p[2], 6), p[:2])
    told.sort(key=place)
    for size, k in ((4096, 40), (16, 40), (16, 5000)):
        monkeypatch.setattr(closest_pairs, "BLOCK", size)
        found = closest_pairs.candidates(given, "label", "vec_id", "embedding", k)
        if k < len(told):
            assert found.count() < len(told)
        got = sorted((tuple(r) for r in found.collect()), key=place)[:k]
        assert repr(got) == repr(told[:k])


def test_mutual_nearest_counts_pairs_where_they_are_made(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(3)), int(rng.integers(1 << 6))) for k in range(300)]
    left = spark.createDataFrame([r for r in rows if r[0] % 2 == 0], "a long, la int, ca long")
    right = spark.createDataFrame([r for r in rows if r[0] % 2], "b long, lb int, cb long")
    gap = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
    pairs = [((x[2] ^ y[2]).bit_count(), x[0], y[0]) for x in rows for y in rows if x[0] % 2 == 0 and y[0] % 2 and x[1] == y[1]]
    forth = {a: min((d, b) for d, p, b in pairs if p == a) for _, a, _ in pairs}
    back = {b: min((d, a) for d, a, p in pairs if p == b) for _, _, b in pairs}
    out = matching.mutual_nearest(left, right, gap, "a", "b", F.col("la") == F.col("lb"))
    assert sorted(map(tuple, out.collect())) == sorted((a, b, d) for a, (d, b) in forth.items() if back[b] == (d, a))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan.split("Join")[-1]
    assert matching.mutual_nearest(left, right, gap, "a", "b").count() > 0


def test_segments_leave_a_worker_in_small_batches(spark):
    import pyarrow as pa

    class Pages:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    pages = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([None if k % 7 == 0 else f"<p>a{k}</p><p>b</p>" for k in range(1000)])], names=["doc_id", "raw"])
    out = [b.to_pylist() for b in markup.segments(Pages())(iter([pages]))]
    assert max(len({r["doc_id"] for r in b}) for b in out) <= markup.AT_ONCE < 1000
    assert [(r["doc_id"], r["ord"], r["text"]) for b in out for r in b] == [(k, i, t) for k in range(1000) if k % 7 for i, t in enumerate((f"a{k}", "b"))]
