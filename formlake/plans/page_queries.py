"""Queries over whole pages: checkbox groups, extents, continued comments, values and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.operators import form_pages
from formlake.operators.form_pages import Field, Form
from formlake.plans.registry import query
from formlake.session import load

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Kind of page and the status it must end with, by customer number.
KINDS = ("grid", "ambiguous_grid", "geometric", "ambiguous_geometric", "paired", "paired", "ambiguous_paired", "none_ticked", "marker_count_mismatch", "unresolved", "grid")
_FORM = Form((Field("name", ("Name",)), Field("segment", ("Segment",), "checkbox", SEGMENTS), Field("place", ("Place of birth",))), ("please tick",))


def checkbox_pages(customers: DataFrame) -> DataFrame:
    """A page per customer with the market segment ticked, drawn in one of the ``KINDS``; the ambiguous ones have the next box ticked too."""
    options = F.array(*map(F.lit, SEGMENTS))
    own = F.array_position(options, F.col("c_mktsegment")).cast("int")
    on = lambda k: k + 1 == own
    two = lambda k: (k + 1 == own) | ((k % 5) == own % 5)
    off = lambda k: F.lit(False)
    join = lambda f, gap=" ": F.array_join(F.transform(options, f), gap)
    box = lambda t: F.when(t, "[x]").otherwise("[ ]")
    named = join(lambda o, k: F.concat(F.lit("<td>"), o, F.lit("</td>")))

    def grid(t: Callable[[Column], Column], between: str = "") -> Column:
        marks = join(lambda o, k: F.concat(F.lit("<td>"), F.when(t(k), "X").otherwise(""), F.lit("</td>")))
        return F.concat(F.lit("<p>Name: A</p><table><tr><td>Segment</td>"), named, F.lit(f"</tr>{between}<tr><td></td>"), marks, F.lit("</tr></table><p>Place of birth: B</p>"))

    def placed(t: Callable[[Column], Column]) -> Column:
        block = lambda x, y, what: F.concat(F.format_string("<|ref|>t<|/ref|><|det|>[[%d, %d, %d, %d]]<|/det|>", x, F.lit(y), x + 60, F.lit(y + 10)), what)
        names = join(lambda o, k: block(100 * k + 100, 10, o), "\n")
        marks = join(lambda o, k: block(100 * k + 105, 30, box(t(k))), "\n")
        return F.concat(F.lit("<|ref|>t<|/ref|><|det|>[[0, 10, 60, 20]]<|/det|>Segment\n"), marks, F.lit("\n"), names)

    def line(t: Callable[[Column], Column], after: bool = True, extra: str = "") -> Column:
        pair = join(lambda o, k: F.concat(o, F.lit(" "), box(t(k))) if after else F.concat(box(t(k)), F.lit(" "), o))
        return F.concat(F.lit("Name: A\nSegment: "), pair, F.lit(f"{extra}\nplease tick\nPlace of birth: B"))

    drawn = [grid(on), grid(two), placed(on), placed(two), line(on), line(on, False), line(two), line(off), line(on, extra=" [ ]"), F.concat(F.lit("Segment "), join(lambda o, k: o)), grid(on, "<tr></tr>")]
    raw = F.get(F.array(*drawn), (F.col("c_custkey") % len(KINDS)).cast("int"))
    return customers.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw"))


_STATUS = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + f"], (1 + c_custkey % {len(KINDS)})::int)"


@query(f"select c_custkey as doc_id, {_STATUS} as status, case when {_STATUS} in ('grid', 'geometric', 'paired') then c_mktsegment else '' end as value from customer")
def p07_checkbox_groups(spark: SparkSession, sf: str) -> DataFrame:
    """All statuses of a checkbox group, one kind of page each."""
    rows = form_pages.field_rows(form_pages.parse(checkbox_pages(load(spark, sf, "customer")), _FORM))
    return rows.filter("field = 'segment'").select("doc_id", F.col("checkbox").alias("status"), "value")


def _order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(o, segs, a): an order's lines as a page's segments; returned ones are labels, some lie in table rows, and ``a`` is the first label."""
    line = F.struct(
        F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("v"), "l_partkey").alias("value"),
        (F.col("l_returnflag") == "R").alias("is_label"),
        F.lit(0).alias("tbl"),
        F.when(F.col("l_quantity").cast("int") % 5 != 0, F.col("l_suppkey") % 4).alias("row"),
        F.when(F.col("l_quantity").cast("int") % 3 != 0, F.col("l_partkey") % 20).alias("x0"),
    )
    pages = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("segs"))
    pages = pages.withColumn("segs", F.transform("segs", lambda x, k: x.withField("ord", k)))
    return pages.withColumn("a", F.get(F.filter("segs", lambda x: x["is_label"]), 0)).filter("a is not null")


_LINES = """with l as (select l_orderkey as o, l_linenumber, 'v' || l_partkey as value, l_returnflag = 'R' as is_label, case when l_quantity::int % 5 <> 0 then l_suppkey % 4 end as r, case when l_quantity::int % 3 <> 0 then l_partkey % 20 end as x from lineitem),
s as (select *, row_number() over (partition by o order by l_linenumber, value, is_label, r nulls first, x nulls first) - 1 as ord from l),
a as (select o, ord as a0, r as ar, x as ax from s where is_label qualify row_number() over (partition by o order by ord) = 1)"""


@query(f"""{_LINES}, m as (select *, max(case when ord > a0 and is_label and not coalesce(r - ar <= 2, false) then 1 else 0 end) over (partition by o order by ord) as stopped from s join a using (o)),
k as (select *, ord = a0 or (ord > a0 and stopped = 0 and not is_label) as main from m)
select o, string_agg(ord::varchar, ',' order by not main, ord) as members from k where main or (r > ar and r <= ar + 2) group by o""")
def p08_group_extent(spark: SparkSession, sf: str) -> DataFrame:
    group = form_pages.group_extent(F.col("segs"), F.col("a"))
    return _order_pages(spark, sf).select("o", F.array_join(F.transform(group, lambda x: x["ord"].cast("string")), ",").alias("members"))


@query(f"""{_LINES}, m as (select *, max(case when ord > a0 and (is_label or coalesce(r <> ar, false) or coalesce(x < ax - 5, false)) then 1 else 0 end) over (partition by o order by ord) as stopped from s join a using (o))
select o, coalesce(string_agg(value, ' ' order by ord) filter (ord > a0 and stopped = 0), '') as comment from m group by o""")
def p09_long_text(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("a")
    return _order_pages(spark, sf).select("o", form_pages.continued(F.col("segs"), a, F.lit(""), a["ord"]).alias("comment"))


_NOTES = Form((Field("name", ("Name",)), Field("first", ("Vorname",)), Field("city", ("Straße des Ortes", "City")), Field("note", ("Note",), "long_text")), ("for office use",))


def note_pages(customers: DataFrame) -> DataFrame:
    """Customers on four kinds of pages: struck-out words, a table, two names in a line and a name twice, boxes; with a comment over three lines."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    struck = F.format_string("<div data-label='Page-Header'>Name: page 7</div><p>Name <del>Someone</del> %s</p><p>Vorname: <del>%s</del></p><p>Note</p><p>a %s</p><p>b</p><p>c</p><p>for office use</p><p>d</p>", name, seg, seg)
    table = F.format_string("<table><tr><td>Name</td><td></td><td>%s</td></tr><tr><td>Vorname</td><td>City</td></tr><tr><td>%s</td><td>\\[ x \\]</td></tr></table>", name, seg)
    line = F.format_string("Name %s Vorname: %s\nstrasse  desOrtes:Ulm\nNote: a\nthe Name is inside\nc %s\nName: twice", name, seg, seg)
    block = lambda x, y, z: F.format_string("<|ref|>t<|/ref|><|det|>[[%d, %d, %d, %d]]<|/det|>", F.lit(x), F.lit(y), F.lit(x + 50), F.lit(z))
    boxes = F.concat(block(10, 0, 10), F.lit("Name\n"), block(200, 0, 10), F.lit("Vorname\n"), block(10, 50, 60), F.lit("Note\n"), block(90, 1, 9), name, F.lit("\n"), block(290, 1, 9), seg, F.lit("\n"), block(90, 52, 100), F.lit("a\nb\n"), block(95, 110, 120), seg, F.lit("\n"), block(0, 130, 140), F.lit("margin\n"))
    raw = F.get(F.array(struck, table, line, boxes), (F.col("c_custkey") % 4).cast("int"))
    return customers.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw"))


_EXPECTED = """list_extract([
{'name': c_name, 'first': c_mktsegment, 'city': '', 'note': 'a ' || c_mktsegment || ' b c', 's': ['inline', 'inline', 'none', 'sequential']},
{'name': c_name, 'first': c_mktsegment, 'city': 'x', 'note': '', 's': ['grid', 'grid', 'grid', 'none']},
{'name': c_name, 'first': c_mktsegment, 'city': 'Ulm', 'note': 'a the Name is inside c ' || c_mktsegment, 's': ['inline', 'inline', 'inline', 'inline']},
{'name': c_name, 'first': c_mktsegment, 'city': '', 'note': 'a b ' || c_mktsegment, 's': ['geometric', 'geometric', 'none', 'geometric']}], (1 + c_custkey % 4)::int)"""


@query(f"""select c_custkey as doc_id, f.field, case k when 1 then e.name when 2 then e.first when 3 then e.city else e.note end as value, e.s[k] as strategy
from (select c_custkey, {_EXPECTED} as e from customer), (values ('name', 1), ('first', 2), ('city', 3), ('note', 4)) f(field, k)""")
def p10_page_fields(spark: SparkSession, sf: str) -> DataFrame:
    return form_pages.field_rows(form_pages.parse(note_pages(load(spark, sf, "customer")), _NOTES)).select("doc_id", "field", "value", "strategy")


@query("""select c_custkey as doc_id, list_extract([3, 3, 4, 3], k) as n_anchored, 4 as n_fields, list_extract([3, 3, 4, 3], k) as n_filled, list_extract([8, 7, 6, 9], k) as n_segments, list_extract(['html', 'html', 'plain', 'grounded'], k) as source,
case when k = 3 then 'name' else '' end as duplicates, case when k = 1 then '__stop_0' else '' end as stops_used, list_extract(['inline', 'grid', 'inline', 'geometric'], k) as mode, list_extract([2, 0, 4, 0], k) as n_inline, list_extract([1, 0, 0, 0], k) as n_sequential, k <> 1 and k <> 4 as city_anchored
from (select c_custkey, (1 + c_custkey % 4)::int as k from customer)""")
def p11_page_report(spark: SparkSession, sf: str) -> DataFrame:
    out = form_pages.report(form_pages.parse(note_pages(load(spark, sf, "customer")), _NOTES))
    return out.select(
        "doc_id", "n_anchored", "n_fields", "n_filled", "n_segments", "source", "mode",
        F.array_join("duplicates", ",").alias("duplicates"), F.array_join("stops_used", ",").alias("stops_used"),
        F.col("n_by_strategy")["inline"].alias("n_inline"), F.col("n_by_strategy")["sequential"].alias("n_sequential"), F.col("anchored")["city"].alias("city_anchored"),
    )
