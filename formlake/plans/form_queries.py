"""Queries over form configurations and plausibility; the layouts come from the table ``part``, eight fields each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import dates
from formlake.operators import flags
from formlake.plans.registry import query
from formlake.session import load
from formlake.sources import configurations as K
from formlake.sources import layouts, lists

_RULES = (None, "none", "numeric", "date", "lexicon", "email", "street_suffix", "name", "llm")
_BOXES = ((0.0, 0.1, 0.4, 0.9), (0.5, 0.1, 0.9, 0.9))


def part_fields(part: DataFrame, unique: bool = True) -> DataFrame:
    """A field per part. Some are not measured, some boxes are empty, some groups have one option, some other fields have options; names repeat unless ``unique``."""
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    measured = key % 7 != 0
    x, y = size * 10.0, size * 12.0
    roi = F.when(measured, F.array(x, y, x + (key % 5) * 30, y + 40))
    option = lambda c, b: F.struct(F.col(c).alias("name"), F.when(measured, F.array(*map(F.lit, b))).alias("box"))
    both = F.array(option("p_type", _BOXES[0]), option("p_brand", _BOXES[1]))
    one = F.array(option("p_type", _BOXES[0]))
    options = F.when(size % 10 == 8, both).when((size % 10 == 3) | (key % 11 == 0), one).otherwise(F.array().cast(K._OPTIONS))
    labels = F.when(key % 3 == 1, F.array("p_name")).when(key % 3 == 2, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    return part.select(
        F.concat(F.lit("form-"), F.expr("p_partkey div 8").cast("string")).alias("layout"), (key % 8).cast("int").alias("ord"),
        (F.concat(name, F.lit("_"), (key % 8).cast("string")) if unique else name).alias("field"), at(layouts.TYPES, size % 5).alias("type"), at(_RULES, size % 9).alias("rule"),
        F.when(size % 3 == 0, "^[0-9]{5}$").alias("pattern"), F.when(size % 4 == 0, F.col("p_brand")).alias("lexicon"), options.alias("options"), roi.alias("roi"), labels.alias("labels"), F.lit(None).cast("string").alias("note"),
    )


def _listed(values: tuple) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _fields_sql(name: str = "replace(p_name, ' ', '_') || '_' || (p_partkey % 8)") -> str:
    return f"""f as (select *, case when size % 10 = 8 then [p_type, p_brand] when size % 10 = 3 or p_partkey % 11 = 0 then [p_type] else [] end as options from
(select 'form-' || (p_partkey // 8) as layout, (p_partkey % 8)::int as ord, {name} as field, {_listed(layouts.TYPES)}[1 + p_size % 5] as type,
{_listed(_RULES)}[1 + p_size % 9] as rule, case when p_size % 3 = 0 then '^[0-9]{{5}}$' end as pattern, case when p_size % 4 = 0 then p_brand end as lexicon,
case when p_partkey % 7 <> 0 then [p_size * 10, p_size * 12, p_size * 10 + (p_partkey % 5) * 30, p_size * 12 + 40]::double[] end as roi,
case p_partkey % 3 when 1 then [p_name] when 2 then [p_name, p_type] else [] end as labels, p_size as size, p_partkey, p_type, p_brand, p_name from part))"""


_F = f"with {_fields_sql()}"
_EFFECTIVE = "coalesce(rule, case when type = 'number' then 'numeric' else 'none' end)"


@query(f"{_F} select layout, ord, field, type, {_EFFECTIVE} as rule, type <> 'ignore' as is_output, type in ('text', 'number', 'long_text') as is_recognised from f")
def a07_layout_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return layouts.described(part_fields(load(spark, sf, "part")))


@query(f"{_F} select layout, field, round(roi[1] / 1000, 6) as x1, round(roi[2] / 1414, 6) as y1, round(roi[3] / 1000, 6) as x2, round(roi[4] / 1414, 6) as y2 from f where roi is not null")
def q01_layout_relative(spark: SparkSession, sf: str) -> DataFrame:
    boxes = part_fields(load(spark, sf, "part")).filter("roi is not null").select("layout", "field", *[F.get("roi", k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    return layouts.to_relative(boxes, 1000, 1414).select("layout", "field", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


def edited_schema(fields: DataFrame) -> DataFrame:
    """The layouts' own fields in reverse order with rule ``name`` for texts; some layouts lack their last field, or have one renamed, or another option."""
    number = F.regexp_extract("layout", "([0-9]+)$", 1).cast("long")
    lost = (number % 3 == 0) & (F.col("ord") == 7)
    field = F.when((number % 5 == 0) & (F.col("ord") == 2), F.concat("field", F.lit("_new"))).otherwise(F.col("field"))
    rule = F.when(F.col("type") == "text", "name")
    options = F.when((number % 7 == 0) & (F.col("ord") == 1), F.array(F.lit("other"))).otherwise(F.transform("options", lambda o: o["name"]))
    kind = F.when(F.col("ord") == 4, "text").otherwise(F.col("type"))
    return fields.filter(~lost).select("layout", (7 - F.col("ord")).alias("ord"), field.alias("field"), kind.alias("type"), rule.alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("lexicon"), options.alias("options"))


_S = f"""{_F}, s as (select layout, 7 - ord as ord, case when n % 5 = 0 and ord = 2 then field || '_new' else field end as field, case when ord = 4 then 'text' else type end as type,
case when type = 'text' then 'name' end as rule, case when n % 7 = 0 and ord = 1 then ['other'] else options end as options
from (select *, regexp_extract(layout, '([0-9]+)$', 1)::bigint as n from f) where not (n % 3 = 0 and ord = 7)),
met as (select coalesce(f.layout, s.layout) as layout, coalesce(f.field, s.field) as field, coalesce(s.type, f.type) as type, coalesce(s.rule, f.rule) as rule, s.ord as ord, f.options as options,
case when f.layout is null then 'not in the layout' when s.layout is null then 'missing from the schema' when len(s.options) > 0 and s.options <> f.options then 'options are the layout''s' end as problem
from f full join s on f.layout = s.layout and f.field = s.field)"""


@query(f"{_S} select layout, field, case problem when 'not in the layout' then 'only in schema' when 'missing from the schema' then 'only in layout' else 'both' end as state from met")
def q02_with_schema(spark: SparkSession, sf: str) -> DataFrame:
    fields = part_fields(load(spark, sf, "part"))
    return layouts.reconciled(edited_schema(fields), fields, ["layout", "field"])


@query(f"""{_S} select layout, (row_number() over (partition by layout order by ord) - 1)::int as ord, field, type, rule, case when type = 'checkbox_group' then len(options) else 0 end::int as n_options
from met where layout not in (select layout from met where problem is not null)""")
def q07_apply_schema(spark: SparkSession, sf: str) -> DataFrame:
    fields = part_fields(load(spark, sf, "part"))
    applied, _ = K.with_schema(fields, edited_schema(fields))
    return applied.select("layout", "ord", "field", "type", "rule", F.size("options").alias("n_options"))


@query(f"{_S} select layout, field, problem from met where problem is not null")
def q03_schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    fields = part_fields(load(spark, sf, "part"))
    return K.with_schema(fields, edited_schema(fields))[1]


@query(f"{_F} select layout, string_agg(ord || '. ' || field || ' (' || type || ')', '; ' order by ord) as prompt from f where type <> 'ignore' group by layout")
def m01_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return layouts.prompt(part_fields(load(spark, sf, "part")))


@query(f"""with {_fields_sql("replace(p_name, ' ', '_')")},
c as (select layout, ord, field, [case when roi[1] >= roi[3] then 'empty box' end, case when type = 'checkbox_group' and len(options) = 1 then 'checkbox group of one option' end,
case when type = 'checkbox_group' and len(options) = 0 then 'checkbox group without options' end,
case when type <> 'checkbox_group' and len(options) > 0 then 'options of no checkbox group' end, case when {_EFFECTIVE} = 'numeric' and pattern is null then 'numeric rule without a pattern' end,
case when rule = 'lexicon' and lexicon is null then 'lexicon rule without a lexicon' end, case when count(*) over (partition by layout, field) > 1 then 'name used twice' end] as found from f)
select layout, ord, field, problem from (select layout, ord, field, unnest(found) as problem from c) where problem is not null""")
def n03_validate_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return K.broken_rules(part_fields(load(spark, sf, "part"), unique=False))


def _box(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda v: F.round(v * 100).cast("long").cast("string")), ",")


_BOX = "array_to_string(list_transform({}, lambda v: round(v * 100)::bigint), ',')"


@query(f"""{_F} select layout, ord, field, type, rule, pattern, lexicon, array_to_string(labels, '|') as labels, {_BOX.format('roi')} as roi,
array_to_string(list_transform(options, lambda o, i: o || case when roi is null then '' else ':' || case i when 1 then '0,10,40,90' else '50,10,90,90' end end), '|') as options from f""")
def a10_configuration_files(spark: SparkSession, sf: str) -> DataFrame:
    """Layouts written as configuration documents and read back from their text."""
    back = K.fields_of(K.parsed(K.documents(part_fields(load(spark, sf, "part"))), "document", "layout"))
    options = F.transform("options", lambda o: F.concat(o["name"], F.coalesce(F.concat(F.lit(":"), _box(o["box"])), F.lit(""))))
    return back.select("layout", "ord", "field", "type", "rule", "pattern", "lexicon", F.array_join("labels", "|").alias("labels"), _box(F.col("roi")).alias("roi"), F.array_join(options, "|").alias("options"))


@query(f"{_F} select layout, count(*)::int as n_fields, bool_and(roi is not null) as has_geometry from f group by layout")
def a11_configurations(spark: SparkSession, sf: str) -> DataFrame:
    return K.listing(K.parsed(K.documents(part_fields(load(spark, sf, "part")))))


@query(f"{_F} select layout, field, (i - 1)::int as ord, labels[i] as label from (select layout, field, labels, unnest(range(1, len(labels) + 1)) as i from f)")
def a13_labels(spark: SparkSession, sf: str) -> DataFrame:
    return K.labels_of(K.fields_of(K.parsed(K.documents(part_fields(load(spark, sf, "part"))))))


_SHOWN = "case type when 'long_text' then 'long' when 'checkbox_group' then 'checkbox' when 'ignore' then 'ignore' else 'short' end"


@query(f"""{_F} select layout, ord, field as name, {_SHOWN} as type, {_EFFECTIVE} as postprocess, case when pattern is null then '' else '{K.CUSTOM}' end as pattern, coalesce(pattern, '') as custom_pattern,
array_to_string(options, ' | ') as options, coalesce(lexicon, '') as lexicon from f""")
def a14_field_table(spark: SparkSession, sf: str) -> DataFrame:
    return K.field_table(part_fields(load(spark, sf, "part")))


@query(f"""with {_fields_sql("replace(p_name, ' ', '_')")},
r as (select layout, ord, case when ord = 6 then '' else field end as field, case when ord = 5 and size % 2 = 0 then 'table' else {_SHOWN} end as shown, {_EFFECTIVE} as rule, pattern, lexicon, options, size from f),
b as (select *, case when field = '' then 'row without a field name' when row_number() over (partition by layout, field order by ord) > 1 then 'name used twice' when shown = 'table' then 'unknown type' end as blocked,
shown in ('checkbox', 'ignore') as bare from r)
select layout, ord, field, case when shown = 'short' and pattern is not null then 'number' when shown = 'short' then 'text' when shown = 'long' then 'long_text' when shown = 'checkbox' then 'checkbox_group' when shown = 'ignore' then 'ignore' end as type,
case when bare then 'none' else rule end as rule, case when not bare then pattern end as pattern, case when shown = 'checkbox' then array_to_string(options, '|') else '' end as options,
coalesce(blocked, concat_ws(', ', case when not bare and rule = 'numeric' and pattern is null then 'numeric rule needs a pattern' end, case when not bare and rule = 'lexicon' and lexicon is null then 'lexicon rule needs a lexicon' end)) as problems,
case when blocked is null then concat_ws(', ', case when bare and rule <> 'none' then 'rule does not apply' end, case when bare and pattern is not null then 'pattern does not apply' end,
case when bare and lexicon is not null then 'lexicon does not apply' end, case when shown <> 'checkbox' and len(options) > 0 then 'options do not apply' end) else '' end as notices, blocked is null as taken from b""")
def n09_judged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Edited field tables with names missing and repeated and types unknown."""
    rows = K.field_table(part_fields(load(spark, sf, "part"), unique=False)).join(load(spark, sf, "part").select(F.concat(F.lit("form-"), F.expr("p_partkey div 8").cast("string")).alias("layout"), (F.col("p_partkey") % 8).cast("int").alias("ord"), "p_size"), ["layout", "ord"])
    rows = rows.withColumn("name", F.when(F.col("ord") == 6, "  ").otherwise(F.col("name"))).withColumn("type", F.when((F.col("ord") == 5) & (F.col("p_size") % 2 == 0), "table").otherwise(F.col("type")))
    out = K.judged(rows)
    return out.select("layout", "ord", "field", "type", "rule", "pattern", *[F.array_join(c, s).alias(c) for c, s in (("options", "|"), ("problems", ", "), ("notices", ", "))], "taken")


@query(f"""{_F} select layout, ord, field, '0,0,100,100' as roi, case when type = 'checkbox_group' then array_to_string(list_transform(options, lambda o, i: o || ':' ||
round(((i - 1) / len(options) + 0.01) * 100)::bigint || ',5,' || round((i / len(options) - 0.01) * 100)::bigint || ',95'), '|') else '' end as options from f""")
def q08_whole_page(spark: SparkSession, sf: str) -> DataFrame:
    schema = part_fields(load(spark, sf, "part")).withColumn("options", F.transform("options", lambda o: o["name"]))
    options = F.transform("options", lambda o: F.concat(o["name"], F.lit(":"), _box(o["box"])))
    return K.whole_page(schema).select("layout", "ord", "field", _box(F.col("roi")).alias("roi"), F.array_join(options, "|").alias("options"))


@query(f"{_F} select layout, field, problem from (select layout, field, case when {_EFFECTIVE} = 'lexicon' and (lexicon is null or lexicon not in (select p_brand from part where p_size < 5)) then 'lexicon is empty or missing' when rule = 'llm' then 'no language model' when {_EFFECTIVE} = 'numeric' and pattern is null then 'numeric rule without a pattern' end as problem from f) where problem is not null")
def i10_idle_rules(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    entries = part.filter("p_size < 5").select(F.col("p_brand").alias("lexicon"), F.col("p_name").alias("entry"))
    return K.idle_rules(part_fields(part), entries, n_domains=1, has_model=False)


@query("select p_brand as lexicon, count(distinct p_name) as n_entries from part group by 1")
def d21_lexicon_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return lists.lexicon_sizes(load(spark, sf, "part").select(F.col("p_brand").alias("lexicon"), F.col("p_name").alias("entry")))


@query("select distinct o_custkey as doc_num, null::varchar as doc_key from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 3)")
def c09_missing_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that orders name and that are not among those at hand."""
    wanted = lists.with_document_key(load(spark, sf, "orders").select("o_custkey"), "o_custkey")
    found = lists.with_document_key(load(spark, sf, "customer").filter("c_custkey % 10 <> 3").select("c_custkey"), "c_custkey")
    return lists.missing_documents(wanted, found)


def order_cells(orders: DataFrame) -> DataFrame:
    """Five cells per order: a birth date in six ways, a name, an amount, a ticked status, an address; all as text."""
    kind, day = F.col("o_orderkey") % 6, F.to_date("o_orderdate")
    month = F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(day) - 1)
    born = [F.date_format(day, "dd.MM.yyyy"), F.concat(F.day(day), F.lit(". "), month, F.lit(" "), F.year(day)), F.lit("31.02.1990"), F.lit(""), F.concat(F.date_format(day, "d/M/"), F.year(day) + 60), F.concat(F.date_format(day, "d - M - "), F.year(day) - 100)]
    amount = F.when(kind == 1, F.lit("zwei")).otherwise(F.col("o_orderkey").cast("string"))
    mail = F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.when(kind == 2, ".de").otherwise("@b.de"))
    name = F.when(kind < 3, F.col("o_orderpriority")).otherwise("Anna")
    status = F.when(kind == 4, "").otherwise(F.col("o_orderstatus"))
    values = [("born", F.get(F.array(*born), kind.cast("int"))), ("name", name), ("amount", amount), ("status", status), ("mail", mail)]
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values])))


@query("""with o as (select o_orderkey as doc_id, o_orderkey % 6 as kind, o_orderdate::date as d, o_orderpriority as p, o_orderstatus as s, (o_orderkey % 4) / 4.0 as score, o_orderkey % 5 = 0 as changed, o_orderkey % 8 = 2 as seen, o_orderkey % 9 = 0 as skipped from orders),
c as (select doc_id, 'born' as field, case kind when 2 then 'not a calendar date' when 4 then case when d + interval 60 year > date '2026-01-01' then 'date lies in the future' end when 5 then case when d = date '2000-02-29' then 'not a calendar date' else 'age is 100 years or more' end end as r, null::varchar as m from o
union all select doc_id, 'name', case when kind < 3 and regexp_matches(p, '[0-9]') then 'digits in a name' end, null from o
union all select doc_id, 'amount', case when kind = 1 then 'not in the number''s format' end, case when seen or skipped or score >= 0.75 then null when score = 0 then 'no confidence' else 'low confidence (' || printf('%.2f', score) || ' < 0.75)' end || case when changed then ' of the raw value' else '' end from o
union all select doc_id, 'status', case when kind = 4 then 'checkbox: no option recognised' when s not in ('F', 'O') then 'checkbox: no such option: ' || s end, null from o
union all select doc_id, 'mail', case when kind = 2 then 'not like an e-mail address' end, case when not skipped and kind = 0 then 'as in demonstration 1, 2' end from o),
n as (select doc_id, field, r, case when field = 'amount' or m is not null then m when field <> 'amount' and doc_id % 9 <> 0 and field <> 'mail' then 'no confidence' when field = 'mail' and doc_id % 9 <> 0 then 'no confidence' end as m from c)
select doc_id, field, concat_ws('; ', r, case when field = 'mail' and doc_id % 9 <> 0 and doc_id % 6 = 0 then 'no confidence; as in demonstration 1, 2' else m end) as reason from n where r is not null or m is not null""")
def n06_plausibility(spark: SparkSession, sf: str) -> DataFrame:
    """All reasons to look at a cell: format, confidence and demonstrations."""
    orders = load(spark, sf, "orders")
    shape = spark.createDataFrame([("born", "number", "date", None, None), ("name", "text", "name", None, None), ("amount", "number", None, r"\d+$", None), ("status", "checkbox_group", None, None, ["F", "O"]), ("mail", "text", "email", None, None)], "field string, type string, rule string, pattern string, options array<string>")
    key = F.col("o_orderkey").alias("doc_id")
    amount = F.lit("amount").alias("field")
    scores = orders.select(key, amount, F.nullif((F.col("o_orderkey") % 4) / 4, F.lit(0.0)).alias("conf_min"))
    changed = orders.filter("o_orderkey % 5 = 0").select(key, amount)
    reviewed = orders.filter("o_orderkey % 8 = 2").select(key, amount)
    bleeding = orders.filter("o_orderkey % 6 = 0").select(key, F.lit("mail").alias("field"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("demo"))
    skipped = orders.filter("o_orderkey % 9 = 0").select(key)
    return flags.plausibility(order_cells(orders), shape, F.lit("2026-01-01").cast("date"), None, scores, 0.75, changed, bleeding, skipped, reviewed)
