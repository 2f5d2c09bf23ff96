"""Whole pages: fixtures of every kind of evidence, and checkbox groups against a plain reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formlake.functions import text
from formlake.operators import form_pages, markup
from formlake.operators.form_pages import Field, Form

OPTIONS = ("IM", "WIN", "BWL", "Kunst")
FORM = Form(
    (
        Field("last", ("Name",)), Field("first", ("Vorname",)), Field("salary", ("Monatliches Einkommen", "Einkommen")), Field("studies", ("Studiengang",), "checkbox", OPTIONS),
        Field("street", ("Straße",)), Field("number", ("Hausnummer",)), Field("zip", ("PLZ", "Postleitzahl")), Field("city", ("Ort",)), Field("comment", ("Kommentar",), "long_text"), Field("signature", ("Unterschrift",), "ignore"),
    ),
    ("Anschrift", "bitte ankreuzen"),
)


def block(box, words):
    return f"<|ref|>text<|/ref|><|det|>{box}<|/det|>\n{words}\n"


#: name: (page, {field: (value, strategy or checkbox status)})
GOLDEN = {
    "columns": (block("[[10,10,90,30]]", "Name") + block("[[10,50,90,70]]", "Vorname") + block("[[10,90,90,110]]", "Kommentar") + block("[[200,12,300,34]]", "Sager") + block("[[200,55,300,80]]", "Emma") + block("[[200,95,500,180]]", "komme gern\nund bald"), {"last": ("Sager", "geometric"), "first": ("Emma", "geometric"), "comment": ("komme gern und bald", "geometric")}),
    "empty block": (block("[[10,10,90,30]]", "Name") + block("[[200,12,300,34]]", "Sager") + "<|ref|>image<|/ref|><|det|>[[1,2,3,4]]<|/det|>", {"last": ("Sager", "geometric")}),
    "boxes by line": (block("[[10,10,90,30],[10,40,90,60],[10,70,90,90]]", "Straße Hafenweg\nHausnummer 67\nOrt 2bingen"), {"street": ("Hafenweg", "inline"), "number": ("67", "inline"), "city": ("2bingen", "inline")}),
    "merged cell": ("<table><tr><td>Straße</td><td>Am Wall</td><td colspan=2>Hausnummer 76</td></tr><tr><td>PLZ</td><td>09050</td><td>Ort Ulm</td></tr></table>", {"street": ("Am Wall", "grid"), "number": ("76", "inline"), "zip": ("09050", "grid"), "city": ("Ulm", "inline")}),
    "later cell": ("<table><tr><td>Monatliches Einkommen</td><td></td><td>542149</td></tr></table>", {"salary": ("542149", "grid")}),
    "two in a line": (block("[[1,2,3,4]]", "Name: Dorn Vorname: Ida") + block("[[1,8,3,9]]", "Anschrift:") + block("[[1,12,3,14]]", "PLZ 6 5 4"), {"last": ("Dorn", "inline"), "first": ("Ida", "inline"), "zip": ("6 5 4", "inline")}),
    "lost blank": ("Straßeavenue Foch", {"street": ("avenue Foch", "inline")}),
    "other spelling": ("Strasse: Kai\nEinkommen 12", {"street": ("Kai", "inline"), "salary": ("12", "inline")}),
    "next block": (block("[[10,10,90,30]]", "Einkommen:") + block("[[10,40,90,60]]", "1592.04"), {"salary": ("1592.04", "sequential")}),
    "typed value": ('<div data-bbox="1 2 3 4" data-label="Page-Header">Name: A-83</div><div data-bbox="1 9 3 14"><p>PLZ <input type="text" value="01650"/></p></div>', {"zip": ("01650", "inline"), "last": ("", "none")}),
    "struck": ("<div data-bbox='1 2 3 4'><p>Ort <del>99050</del> Lindau</p><p>Name <del>Gil Didier</del></p></div>", {"city": ("Lindau", "inline"), "last": ("Gil Didier", "inline")}),
    "label inside a value": ("Straße\nReimor - Straße\nName\nOrt der Name", {"street": ("Reimor - Straße", "sequential"), "last": ("", "none"), "city": ("der", "inline")}),
    "stacked": ("<table><tr><td>Name</td><td>Vorname</td></tr><tr><td>Lo</td><td>Ada</td></tr></table>", {"last": ("Lo", "grid"), "first": ("Ada", "grid")}),
    "wrapped cell": ("<table><tr><td>Kommentar</td><td>eins<br/>zwei drei</td></tr><tr><td>fremd</td></tr></table>", {"comment": ("eins zwei drei", "grid")}),
    "three lines": ("Kommentar: eins\nzwei\ndrei\nUnterschrift\nvier", {"comment": ("eins zwei drei", "inline")}),
    "outdent": (block("[[50,10,90,30]]", "Kommentar") + block("[[60,40,90,60]]", "eins") + block("[[46,70,90,90]]", "zwei") + block("[[10,100,90,120]]", "drei"), {"comment": ("eins zwei", "sequential")}),
    "spanned ticks": ("<table><tr><td>Studiengang</td><td>IM</td><td>WIN</td><td colspan=3>Kunst</td></tr><tr><td></td><td></td><td></td><td colspan=3>[x]</td></tr></table>", {"studies": ("Kunst", "grid")}),
    "ticks under other rows": ("<table><tr><td>Studiengang</td></tr><tr><td>IM</td><td>WIN</td></tr><tr><td>✓</td><td>☐</td></tr></table>", {"studies": ("IM", "grid")}),
    "two ticks": ("<table><tr><td>Studiengang</td><td>IM</td><td>WIN</td></tr><tr><td></td><td>X</td><td>x</td></tr></table>", {"studies": ("", "ambiguous_grid")}),
    "blocks": ("".join(block(b, t) for b, t in (("[[0,0,50,10]]", "Studiengang"), ("[[100,0,130,10]]", "☒"), ("[[140,0,170,10]]", "IM"), ("[[200,0,230,10]]", "☐"), ("[[240,0,270,10]]", "WIN"))), {"studies": ("IM", "geometric")}),
    "two ticked blocks": ("".join(block(b, t) for b, t in (("[[0,0,50,10]]", "Studiengang"), ("[[100,0,130,10]]", "☒"), ("[[140,0,170,10]]", "IM"), ("[[200,0,230,10]]", "[x]"), ("[[240,0,270,10]]", "WIN"))), {"studies": ("", "ambiguous_geometric")}),
    "boxes behind": ("Studiengang IM [ ] WIN [x] BWL [ ]\nbitte ankreuzen", {"studies": ("WIN", "paired")}),
    "boxes in front": ("Studiengang\n[ ] im [x] WIN\nKunst [ ]\nOrt", {"studies": ("WIN", "paired")}),
    "two boxes ticked": ("Studiengang IM [x] WIN ☑", {"studies": ("", "ambiguous_paired")}),
    "no box ticked": ("Studiengang IM [ ] WIN ☐", {"studies": ("", "none_ticked")}),
    "a box too many": ("Studiengang [ ] IM [ ] WIN [x] BWL [ ] Kunst [ ]", {"studies": ("", "marker_count_mismatch")}),
    "no boxes": ("Studiengang: IM WIN", {"studies": ("", "unresolved")}),
}


@pytest.fixture(scope="module")
def parsed(spark):
    pages = [(k, p, "clash") for k, (p, _) in enumerate(GOLDEN.values())] + [(-1, None, ""), (-2, "", ""), (-3, " \n", ""), (-2, "Ort Ulm", "")]
    return form_pages.parse(spark.createDataFrame(pages, "doc_id long, raw string, segs string"), FORM).cache()


def test_golden_pages(parsed):
    got = {}
    for r in form_pages.field_rows(parsed).collect():
        got.setdefault(r["doc_id"], {})[r["field"]] = (r["value"], r["checkbox"] or r["strategy"])
    for k, (name, (_, want)) in enumerate(GOLDEN.items()):
        assert {f: got[k][f] for f in want} == want, name
    statuses = {v[1] for _, want in GOLDEN.values() for f, v in want.items() if f == "studies"}
    assert statuses == {"grid", "ambiguous_grid", "geometric", "ambiguous_geometric", "paired", "ambiguous_paired", "none_ticked", "marker_count_mismatch", "unresolved"}


def test_reports(parsed):
    rows = form_pages.report(parsed).collect()
    assert len(rows) == len(GOLDEN) + 4
    by = {r["doc_id"]: r for r in rows}
    names = list(GOLDEN)
    r = by[names.index("two in a line")]
    assert (r["n_anchored"], r["n_fields"], r["n_filled"], r["stops_used"], r["mode"], r["source"]) == (3, 9, 3, ["__stop_0"], "inline", "grounded")
    assert by[names.index("label inside a value")]["anchored"]["street"] and by[names.index("boxes behind")]["checkbox"] == {"studies": "paired"}
    assert by[-1]["n_segments"] == 0 and by[-1]["mode"] == "none" and by[-1]["n_by_strategy"] == dict.fromkeys(form_pages.STRATEGIES, 0)
    assert sorted(r["n_filled"] for r in rows if r["doc_id"] == -2) == [0, 1]


def plain_group(group, options):
    """The rules for a group, read one after another."""
    tick = re.compile(rf"\[\s*[{text.TICKS}]\s*\]|[{text.TICKS}]")
    box = re.compile(rf"\[\s*[{text.TICKS}]?\s*\]|[☐☑☒□❑]")
    empty = re.compile(r"\[\s*\]|[☐□❑]")
    lower = [o.lower() for o in options]
    number = {x: k for k, x in reversed(list(enumerate(lower)))}
    value = lambda t: t.strip().lower()
    cells = {(g["tbl"], g["row"], g["col"]): g["text"] for g in group if g["row"] is not None}
    for t, r in sorted({(t, r) for (t, r, c), x in cells.items() if value(x) in number}):
        own = {c: number[value(x)] for (tt, rr, c), x in cells.items() if (tt, rr) == (t, r) and value(x) in number}
        below = [d for d in (1, 2) if any((t, r + d, c) in cells for c in own)]
        if len(own) < 2 or not below:
            continue
        hits = [o for c, o in own.items() if tick.fullmatch(cells.get((t, r + below[0], c), "").strip())]
        if hits:
            return (options[hits[0]], "grid") if len(hits) == 1 else ("", "ambiguous_grid")
    boxed = [g for g in group if g["x0"] is not None]
    named = [(g, number[value(box.sub(" ", g["text"]))]) for g in boxed if value(box.sub(" ", g["text"])) in number]
    marks = [g for g in boxed if box.fullmatch(g["text"].strip())]
    if marks and len(marks) == len(named):
        far = lambda m, g: 2 * abs(m["x0"] - g["x0"]) + abs(m["y0"] + m["y1"] - g["y0"] - g["y1"])
        on = [min(named, key=lambda n: far(m, n[0]))[1] for m in marks if tick.fullmatch(m["text"].strip())]
        if len(set(on)) == 1:
            return options[on[0]], "geometric"
        if on:
            return "", "ambiguous_geometric"
    span = "\n".join(g["text"] for g in group)
    found = [not empty.fullmatch(m[0].strip()) for m in box.finditer(span)]
    at = sorted((m.start(), o) for o in dict.fromkeys(options) if (m := re.search(rf"(?<![A-Za-z]){re.escape(o)}(?![A-Za-z])", span, re.I)))
    if found and len(found) == len(at):
        return ("", "none_ticked") if not any(found) else (at[found.index(True)][1], "paired") if sum(found) == 1 else ("", "ambiguous_paired")
    return "", "marker_count_mismatch" if found else "unresolved"


def test_checkbox_rules_by_brute_force(spark):
    rng = random.Random(9)
    options = ("IM", "WIN", "a.b", "IM")
    groups = []
    for _ in range(500):
        kind = rng.choice(("grid", "boxes", "line"))
        group = []
        for k in range(rng.randrange(1, 9)):
            words = rng.choice([*options, "im ", "[x]", "[ ]", "☐", "☑", "☒", "X", "", "IM [x]", "WIN [ ]", "a.b", "axb", "other"])
            box = [rng.randrange(0, 60, 5), rng.randrange(0, 30, 5)] if kind == "boxes" or rng.random() < 0.1 else None
            cell = (0, rng.randrange(3), rng.randrange(3)) if kind == "grid" else None
            if cell and any((g["row"], g["col"]) == cell[1:] for g in group):
                continue
            group.append({"ord": k, "text": words, "x0": box and box[0], "y0": box and box[1], "x1": box and box[0] + 5, "y1": box and box[1] + 5, "tbl": cell and 0, "row": cell and cell[1], "col": cell and cell[2]})
        groups.append(group)
    kind = "array<struct<ord:int,text:string,x0:int,y0:int,x1:int,y1:int,tbl:int,row:int,col:int>>"
    rows = spark.createDataFrame(list(enumerate([[tuple(g.values()) for g in group] for group in groups])), f"k int, g {kind}")
    told = form_pages.resolved_checkbox(F.col("g"), F.array(*map(F.lit, options)))
    got = [(options[r["t"]["option"] - 1] if r["t"]["option"] else "", r["t"]["status"]) for r in rows.select("k", told.alias("t")).orderBy("k").collect()]
    want = [plain_group(g, options) for g in groups]
    assert got == want and len({s for _, s in want}) >= 8


def test_segments_keep_what_the_page_says():
    page = "<table><tr><td></td><td>a <del>b</del></td></tr></table>"
    assert [(t, r, c) for t, _, _, r, c, _ in markup.page_segments(page, whole=True)] == [("", 0, 0), (f"a {text.STRUCK}b{text.UNSTRUCK}", 0, 1)]
    assert [x[0] for x in markup.page_segments(page)] == ["a"]
    assert markup.page_segments("<div data-bbox='1.5 -2 3 4'>a</div><div data-bbox='1 2 3'>b</div>")[0][1] == (1, -2, 3, 4)
    assert markup.page_segments("<div data-bbox='1 2 3'>b</div>")[0][1] is None


def test_pages_of_one_file_are_many_tasks(spark):
    rows = spark.range(400).coalesce(1).selectExpr("id as doc_id", "'Name: A' as raw")
    parsed = form_pages.parse(rows, form_pages.Form((form_pages.Field("name", ("Name",)),)))
    per_task = [n for n in parsed.select("doc_id", "fields").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per_task) < 150
