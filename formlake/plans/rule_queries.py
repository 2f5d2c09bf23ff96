"""Queries over scalar functions and correction rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import dates, geometry, json_fields, text
from formlake.operators import flags, guardrail, rules
from formlake.plans.registry import query
from formlake.session import load
from formlake.sources import lists

_MAP = "'HkGjgqoOsSrlIiBZF', '44699900555111827'"


@query(f"select c_custkey, translate(c_name, {_MAP}) as mapped from customer")
def h01_digit_map(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", text.digit_map(F.col("c_name")).alias("mapped"))


@query("select doc_id, replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') as plain from documents")
def h02_umlaut_expand(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.for_matching(F.col("text")).alias("plain"))


@query("""select doc_id, mail, regexp_extract(mail, '^(.*)@([^@]*)$', 1) as local, regexp_extract(mail, '^(.*)@([^@]*)$', 2) as domain
from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+')) as mail from documents)""")
def h03_email_extract_split(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+"), 0)).alias("mail"))
    return found.select("doc_id", "mail", text.email_local(F.col("mail")).alias("local"), text.email_domain(F.col("mail")).alias("domain"))


def _stripped_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def _without_formulas_sql(x: str) -> str:
    for _ in range(3):
        x = f"regexp_replace({x}, '{text.formula_pattern()}', ' \\1\\2\\3\\4\\5 ', 'g')"
    return rf"regexp_replace({x}, '(?i)\\[\[\]()]|</?math[^>]*>', ' ', 'g')"


def _clean_sql(x: str) -> str:
    x = _stripped_sql(_without_formulas_sql(f"replace({x}, '{text.STOP_SIGN}', ' ')"))
    x = rf"regexp_replace(regexp_replace({x}, '^#+\s*', ''), '\*{{1,3}}|_{{2,}}', '', 'g')"
    return _stripped_sql(rf"regexp_replace({x}, '[ \t\x{{a0}}]+', ' ', 'g')")


@query(f"select doc_id, {_clean_sql('text')} as clean from documents")
def h04_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


_WRAPPED = (("\\[ ", " \\]"), ("\\(", "\\)"), ("$$", "$$"), ("<math a>", "</MATH>"), ("**", "**"), ("# __", "__"), ("\\[" * 10, "\\]" * 10), ("\\[<math>\\( " * 4, " \\)</math>\\]" * 4))


@query("select p_partkey, p_name || ' a_b ' || p_size as clean from part")
def h07_formulas(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % len(_WRAPPED)).cast("int")
    side = lambda n: F.get(F.array(*[F.lit(w[n]) for w in _WRAPPED]), k)
    raw = F.concat(side(0), F.col("p_name"), side(1), F.lit(" a_b $"), F.col("p_size").cast("string"), F.lit("$"))
    return load(spark, sf, "part").select("p_partkey", text.clean_text(raw).alias("clean"))


_VALUES = ("case p_partkey % 5 when 0 then ': - ' || p_name || ' |_' when 1 then '[x]' when 2 then '– ' || p_name || ':' when 3 then '☐ [ ] ☒' else p_name end")


@query("select p_partkey, case when p_partkey % 5 in (1, 3) then '' else p_name end as value from part")
def h08_clean_value(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", text.clean_value(F.expr(_VALUES)).alias("value"))


@query("""select conv_id, turn, case when regexp_matches(c, '[.!?]$') and not regexp_matches(o, '[.!?]$') then regexp_replace(c, '\\s*[.!?]$', '') else c end as value
from (select conv_id, turn, coalesce(text, '') as o, coalesce(text, '') || case turn % 3 when 0 then ' !' when 1 then '.' else '' end as c from conversations)""")
def h09_added_end(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").withColumn("o", F.coalesce("text", F.lit("")))
    corrected = F.concat("o", F.when(F.col("turn") % 3 == 0, " !").when(F.col("turn") % 3 == 1, ".").otherwise(""))
    return rows.select("conv_id", "turn", text.without_added_end(F.col("o"), corrected).alias("value"))


@query("""select event_id, json_extract_string(props, '$.k') as k, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') as extra from events""")
def h05_json_props(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events")
    fields = json_fields.fields_of(F.col("props"))
    return rows.select("event_id", fields["k"].alias("k"), F.array_join(json_fields.extra_keys(F.json_object_keys("props"), ["k"]), ",").alias("extra"))


@query("""select o_orderkey, lpad(cast(o_orderkey as varchar), greatest(8, length(cast(o_orderkey as varchar)))::int, '0') as zeros from orders""")
def h06_json_quote_bare(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.concat(F.lit('note {"k": '), text.zero_padded(F.col("o_orderkey"), 8), F.lit(', "n": null} end'))
    return load(spark, sf, "orders").select("o_orderkey", json_fields.fields_of(bare)["k"].alias("zeros"))


_NUMBER = "translate(lpad(cast(c_custkey as varchar), 5, '0'), '0125', 'OlZS')"


@query(f"""select c_custkey, raw, case when regexp_matches(raw, '^[0-9]{{5}}$') then raw when regexp_matches(translate(raw, {_MAP}), '^[0-9]{{5}}$') then translate(raw, {_MAP}) else raw end as fixed
from (select c_custkey, {_NUMBER} || case when c_custkey % 7 = 0 then 'x' else '' end as raw from customer)""")
def r01_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.translate(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), "0125", "OlZS"), F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(""))
    return load(spark, sf, "customer").select("c_custkey", raw.alias("raw")).withColumn("fixed", rules.numeric(F.col("raw"), "[0-9]{5}$"))


_DATE = "(1 + o_orderkey % 33) || '.' || (1 + o_orderkey % 13) || '.' || (1990 + o_orderkey % 30)"
_OK = "try_strptime(regexp_replace(translate(raw, {m}), '^([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.', '\\1.\\2.'), '%d.%m.%Y') is not null".format(m=_MAP)


@query(f"""select o_orderkey, raw, case when {_OK} then translate(raw, {_MAP}) else raw end as fixed from (select o_orderkey, translate({_DATE}, '13', 'lE') as raw from orders where o_orderkey % 33 <> 100)
where not regexp_matches(raw, 'E')
union all select o_orderkey, raw, raw from (select o_orderkey, translate({_DATE}, '13', 'lE') as raw from orders) where regexp_matches(raw, 'E')""")
def r02_date_numeric(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat_ws(".", (1 + k % 33).cast("string"), (1 + k % 13).cast("string"), (1990 + k % 30).cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", F.translate(raw, "13", "lE").alias("raw")).withColumn("fixed", rules.date(F.col("raw")))


@query("""select o_orderkey, raw, case when o_orderkey % 5 = 4 then raw else (1 + o_orderkey % 28) || '. ' || list_extract(['Januar','Februar','April','Mai','Juni','Juli','August','September','Oktober','November','Dezember'], (1 + o_orderkey % 11)::int) || ' ' || (1950 + o_orderkey % 60) end as fixed
from (select o_orderkey, (1 + o_orderkey % 28) || '. ' || case when o_orderkey % 5 = 4 then 'Xyzzyabc' else list_extract(['Jamuar','Februor','Aprll','Maii','Junl','Julii','Auqust','Septenber','Oktuber','Novemher','Dezembor'], (1 + o_orderkey % 11)::int) end || ' ' || (1950 + o_orderkey % 60) as raw from orders)""")
def r03_date_month(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    broken = F.array(*map(F.lit, ("Jamuar", "Februor", "Aprll", "Maii", "Junl", "Julii", "Auqust", "Septenber", "Oktuber", "Novemher", "Dezembor")))
    word = F.when(k % 5 == 4, "Xyzzyabc").otherwise(F.get(broken, (k % 11).cast("int")))
    raw = F.concat((1 + k % 28).cast("string"), F.lit(". "), word, F.lit(" "), (1950 + k % 60).cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("fixed", rules.date(F.col("raw")))


_BROKEN = "case p_partkey % 3 when 0 then replace(p_name, 'e', 'c') when 1 then p_name || 'x' else p_name end"


@query(f"""with lex as (select entry, row_number() over (order by entry) as ord from (select distinct trim(p_name) as entry from part)), v as (select distinct {_BROKEN} as raw from part),
best as (select raw, arg_min(entry, levenshtein(lower(raw), lower(entry)) * 100000 + ord) as fixed from v, lex where levenshtein(lower(raw), lower(entry)) <= 0.34 * length(raw) and abs(length(raw) - length(entry)) <= 0.34 * length(raw) group by raw)
select p_partkey, coalesce(case when exists (select 1 from lex where entry = t.raw) then t.raw end, b.fixed, t.raw) as value from (select p_partkey, {_BROKEN} as raw from part) t left join best b on t.raw = b.raw""")
def r04_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    k = F.col("p_partkey") % 3
    broken = F.when(k == 0, F.replace("p_name", F.lit("e"), F.lit("c"))).when(k == 1, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    return rules.lexicon(part.select("p_partkey", broken.alias("value")), lists.sorted_lexicon(part, "p_name"))


DOMAINS = ("example.com", "mail.example.org", "post.example.net")


@query("""select c_custkey, 'c' || c_custkey || '@' || list_extract(['example.com','example.com','mail.example.org','post.example.net','other.invalid','example.com'], (1 + c_custkey % 6)::int) as value from customer""")
def r05_email(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    broken = F.array(*map(F.lit, ("Exampel.com", "example. com", "mail.exampel.org", "post.exarnple.net", "other.invalid", "exanple.con")))
    raw = F.concat(F.lit("C"), k.cast("string"), F.lit("@"), F.get(broken, (k % 6).cast("int")))
    return load(spark, sf, "customer").select("c_custkey", rules.email(raw, DOMAINS).alias("value"))


SUFFIXES = ("strasse", "weg", "platz", "allee", "gasse")


@query("""select c_custkey, list_extract(['Hauptstrasse','Anna-Meyer-Weg','Marktplatz','Lindenallee','Am Hang','Rosengasse'], (1 + c_custkey % 6)::int) as value from customer""")
def r06_street_suffix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    broken = F.array(*map(F.lit, ("Hauptstrosse", "Anna-Meyer-Weq", "Marktplotz", "Lindenallee", "Am Hang", "Rosengosse ")))
    return load(spark, sf, "customer").select("c_custkey", rules.street_suffix(F.get(broken, (k % 6).cast("int")), SUFFIXES).alias("value"))


@query("""select c_custkey, upper(n[1]) || lower(n[2:]) as value from (select c_custkey, trim(regexp_replace(regexp_replace(translate(replace(c_name, '#', ''), '01245689', 'oizhsgbg'), '[^A-Za-z '']', '', 'g'), '\\s+', ' ', 'g')) as n from customer)""")
def r07_name(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", rules.name(F.regexp_replace("c_name", "[#-]", "")).alias("value"))


@query()
def r08_guardrail(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("original"))
    changed = F.when(F.col("turn") % 2 == 0, F.regexp_replace("original", "the", "tha")).otherwise(F.reverse("original"))
    return rows.withColumn("proposed", changed).select("conv_id", "turn", guardrail.corrected(F.col("original"), F.col("proposed")).alias("value"))


@query("""select doc_id, x1, y1, x2, y2 from (select p_partkey as doc_id, trunc(p_size / 64.0 * 1000)::int as x1, trunc(p_size / 80.0 * 700)::int as y1, least(1000, round_even(p_retailprice / 2, 0)::int) as x2, least(700, round_even(p_retailprice / 3, 0)::int) as y2 from part)""")
def g06_box_rel_abs(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    x1, y1 = geometry.to_pixels(F.col("p_size") / F.lit(64.0), F.lit(1000)), geometry.to_pixels(F.col("p_size") / F.lit(80.0), F.lit(700))
    _, x2 = geometry.clipped(F.lit(0), F.col("p_retailprice") / 2, F.lit(1000))
    _, y2 = geometry.clipped(F.lit(0), F.col("p_retailprice") / 3, F.lit(700))
    return part.select(F.col("p_partkey").alias("doc_id"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


_H = (1.01, 0.02, 3.0, -0.01, 0.99, 5.0, 0.00001, 0.00002, 1.0)
_P = lambda x, y: tuple(f"(({_H[3 * r]} * {x} + {_H[3 * r + 1]} * {y} + {_H[3 * r + 2]}) / ({_H[6]:.5f} * {x} + {_H[7]:.5f} * {y} + {_H[8]}))" for r in (0, 1))
_CORNERS = [_P(x, y) for x, y in (("p_size", "p_size"), ("(p_size + 40)", "p_size"), ("(p_size + 40)", "(p_size + 20)"), ("p_size", "(p_size + 20)"))]


@query("select p_partkey, " + ", ".join(f"round({f}({', '.join(c[k] for c in _CORNERS)}), 4) as {n}" for n, f, k in (("x1", "least", 0), ("y1", "least", 1), ("x2", "greatest", 0), ("y2", "greatest", 1))) + " from part")
def g07_homography_warp(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    box = geometry.warped_box(s, s, s + 40, s + 20, _H)
    return load(spark, sf, "part").select("p_partkey", *[F.round(c, 4).alias(n) for n, c in box.items()])


@query("select o_orderkey, case when a > 45 then a - 90 else a end as angle from (select o_orderkey, ((o_orderkey * 5 - 400) % 90 + 90) % 90 as a from orders)")
def g08_angle_fold(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", geometry.folded_angle(F.col("o_orderkey") * 5 - 400).alias("angle"))


@query("""select p_partkey, floor(w * f)::bigint as w, floor(h * f)::bigint as h, floor(floor(w * f) * floor(h * f) / 784)::bigint as tokens from (select *, least(1.0::double, sqrt(802816.0::double / (w * h))) as f from (select p_partkey, 600 + p_size * 40 as w, 800 + p_size * 31 as h from part))""")
def g09_pixel_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select("p_partkey", (600 + F.col("p_size") * 40).alias("pw"), (800 + F.col("p_size") * 31).alias("ph"))
    w, h, tokens = geometry.within_budget(F.col("pw"), F.col("ph"), 1024)
    return rows.select("p_partkey", w.alias("w"), h.alias("h"), tokens.alias("tokens"))


@query("""select o_orderkey, case when o_orderpriority is null or o_orderpriority = '' then null when regexp_matches(o_orderpriority, '^1-') then 'urgent' when not regexp_matches(o_orderpriority, '^[0-9]-[A-Z ]+$') then 'pattern' when o_totalprice > 200000 then 'price' end as reason from orders
where case when o_orderpriority is null or o_orderpriority = '' then null when regexp_matches(o_orderpriority, '^1-') then 'urgent' when not regexp_matches(o_orderpriority, '^[0-9]-[A-Z ]+$') then 'pattern' when o_totalprice > 200000 then 'price' end is not null""")
def n01_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    checks = [(p.rlike("^1-"), "urgent"), (~p.rlike("^[0-9]-[A-Z ]+$"), "pattern"), (F.col("o_totalprice") > 200000, "price")]
    return flags.first_reason(load(spark, sf, "orders"), p, checks).select("o_orderkey", "reason")


@query("""select event_type, count(value) as n_scored, count(*) filter (value is null) as n_unscored, count(*) filter (coalesce(value, 0) < 0.75) as n_below from (select event_type, case when event_id % 11 = 0 then null else value / 100 end as value from events) group by 1""")
def n02_confidence_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value") / 100).alias("value"))
    return flags.confidence_totals(rows, ["event_type"], "value", 0.75)


@query("""select o_orderkey as doc_id, 'o_orderstatus' as field, o_orderstatus as before, 'X' as after from orders where o_orderkey % 10 = 0 and o_orderstatus <> 'X'""")
def n04_manual_edits(spark: SparkSession, sf: str) -> DataFrame:
    from formlake.operators import cells

    base = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id")
    edited = base.withColumn("o_orderstatus", F.when(F.col("doc_id") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    fields = ["o_orderstatus", "o_orderpriority"]
    return cells.change_table(cells.to_cells(base, "doc_id", fields), cells.to_cells(edited, "doc_id", fields), "doc_id")


@query("""select o_orderkey, d, case when d > date '2020-06-01' then 'date lies in the future' when d <= date '1920-06-01' then 'age is 100 years or more' end as reason from (select o_orderkey, (date '1915-01-01' + (o_orderkey * 7 % 39000)::int) as d from orders)""")
def n05_birth_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", F.date_add(F.lit("1915-01-01").cast("date"), (F.col("o_orderkey") * 7 % 39000).cast("int")).alias("d"))
    return rows.withColumn("reason", dates.age_reason(F.col("d"), F.lit("2020-06-01").cast("date")))
