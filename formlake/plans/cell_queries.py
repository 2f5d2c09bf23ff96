"""Queries over cells, sets and lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import text
from formlake.operators import cells as C
from formlake.operators import rules
from formlake.plans.registry import query
from formlake.session import load, work_dir
from formlake.sources import lists, text_csv

PART_FIELDS = ("p_name", "p_brand", "p_type")


def part_cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.to_cells(load(spark, sf, "part"), "p_partkey", PART_FIELDS)


_CELLS = """select p_partkey, 'p_name' as field, coalesce(p_name, '') as value from part
union all select p_partkey, 'p_brand', coalesce(p_brand, '') from part
union all select p_partkey, 'p_type', coalesce(p_type, '') from part"""


@query(_CELLS)
def a01_cells_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return part_cells(spark, sf)


@query("select p_partkey, coalesce(p_name, '') as p_name, coalesce(p_brand, '') as p_brand, coalesce(p_type, '') as p_type from part")
def a02_predictions_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return C.to_wide(part_cells(spark, sf), "p_partkey", PART_FIELDS)


@query("select 0 as n_mismatches")
def a03_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    wide = C.to_wide(part_cells(spark, sf), "p_partkey", PART_FIELDS).withColumn("p_name", F.concat(F.col("p_name"), F.lit(' "q"\n, 007')))
    wide = wide.withColumn("p_partkey", F.col("p_partkey").cast("string"))
    path = f"{work_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    text_csv.write_text_csv(wide, path, "p_partkey")
    wrong = C.roundtrip_mismatches(wide, text_csv.read_text_csv(spark, path, wide.columns), "p_partkey", PART_FIELDS)
    return wrong.agg(F.count("*").cast("int").alias("n_mismatches"))


@query("select c_custkey, c_name, try_cast(nullif(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1), '') as bigint) as doc_id from customer")
def a04_doc_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_name", text.document_number(F.col("c_name")).alias("doc_id"))


@query("""select entry, row_number() over (order by pos) as ord from
(select o_orderpriority as entry, min(o_orderkey) as pos from orders where trim(o_orderpriority) <> '' group by 1)""")
def a05_ordered_list_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return lists.first_occurrences(load(spark, sf, "orders"), "o_orderpriority", "o_orderkey").withColumn("ord", F.col("ord").cast("long"))


@query("select entry, row_number() over (order by entry) as ord from (select distinct trim(p_name) as entry from part where trim(p_name) <> '')")
def a06_lexicon_load(spark: SparkSession, sf: str) -> DataFrame:
    return lists.sorted_lexicon(load(spark, sf, "part"), "p_name").withColumn("ord", F.col("ord").cast("long"))


@query("""select p_partkey, regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as run_name from part""")
def a08_slug_run_name(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("run_name"))


@query("select d.doc_id, coalesce(cast(l.quality as varchar), '') as quality, coalesce(cast(l.toxic as varchar), '') as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def b01_reindex_missing(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", text.text_of(F.col("quality")).alias("quality"), text.text_of(F.col("toxic")).alias("toxic"))


@query("select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def b02_semi_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "lang", "source").join(load(spark, sf, "labels"), "doc_id", "left_semi")


@query("select doc_id, lang, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def b03_anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "lang", "source").join(load(spark, sf, "labels"), "doc_id", "left_anti")


@query("select count(*) as n_common from (select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 0)")
def b04_disjoint_check(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "documents").filter("lang = 'en'").select("doc_id")
    return a.intersect(load(spark, sf, "labels").filter("quality = 0").select("doc_id")).agg(F.count("*").alias("n_common"))


def noisy_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Order and part keys as recognised text with look-alike letters, and broken part names."""
    o = load(spark, sf, "orders")
    number = text.zero_padded(F.col("o_orderkey"), 5)
    keys = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("number").alias("field"), F.when(F.col("o_orderkey") % 3 == 0, F.translate(number, "015", "olS")).otherwise(number).alias("value"))
    dates = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("date").alias("field"), F.translate(F.date_format("o_orderdate", "d.M.yyyy"), "1", "l").alias("value"))
    return keys.unionByName(dates)


_NOISY = """select o_orderkey as doc_id, 'number' as field, case when o_orderkey % 3 = 0 then translate(lpad(cast(o_orderkey as varchar), greatest(5, length(cast(o_orderkey as varchar)))::int, '0'), '015', 'olS') else lpad(cast(o_orderkey as varchar), greatest(5, length(cast(o_orderkey as varchar)))::int, '0') end as value from orders
union all select o_orderkey, 'date', translate(strftime(o_orderdate, '%-d.%-m.%Y'), '1', 'l') from orders"""
_FIXED = f"""select doc_id, field, value as before, case field
when 'number' then case when regexp_matches(value, '^[0-9]{{5}}$') then value when regexp_matches(translate(value, 'HkGjgqoOsSrlIiBZF', '44699900555111827'), '^[0-9]{{5}}$') then translate(value, 'HkGjgqoOsSrlIiBZF', '44699900555111827') else value end
else translate(value, 'l', '1') end as after from ({_NOISY})"""


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The noisy cells with their corrected values beside them."""
    return rules.corrected(noisy_cells(spark, sf), [("number", "numeric", "[0-9]{5}$"), ("date", "date", None)], name="after")


@query(f"select doc_id, field, before, after from ({_FIXED}) where before <> after")
def c01_diff_cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.changed_cells(corrections(spark, sf), "doc_id")


@query(f"select field, count(*) as n_changed, round(count(*) / (select count(*) from ({_NOISY})), 6) as share from ({_FIXED}) where before <> after group by field")
def d01_changes_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return C.changes_by_field(corrections(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which cells the correction changes, by field, and their share of all cells."""
    return d01_changes_by_field(spark, sf).orderBy(F.desc("n_changed"))


@query("""select l_returnflag, count(l_extendedprice) as n, min(l_extendedprice) as low, round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(quantile_cont(l_extendedprice, 0.5), 4) as q2,
round(quantile_cont(l_extendedprice, 0.75), 4) as q3, max(l_extendedprice) as high from lineitem group by 1""")
def d02_describe_groups(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile("l_extendedprice", [0.25, 0.5, 0.75])
    out = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("l_extendedprice").alias("n"), F.min("l_extendedprice").alias("low"), q.alias("q"), F.max("l_extendedprice").alias("high"))
    return out.select("l_returnflag", "n", "low", *[F.round(F.col("q")[k], 4).alias(f"q{k + 1}") for k in range(3)], "high")


@query("""with n as (select user_id, event_type, count(*) as n from events group by 1, 2)
select user_id, sum(n)::bigint as n_all, arg_max(event_type, n * 100 - case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else 3 + ascii(event_type) % 50 end) as dominant from n group by 1""")
def d04_strategy_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).otherwise(3 + F.ascii("event_type") % 50)
    return n.groupBy("user_id").agg(F.sum("n").alias("n_all"), F.max_by("event_type", F.col("n") * 100 - rank).alias("dominant"))


@query("select conv_id, string_agg(coalesce(text, ''), ' ' order by turn) as text, count(*) as n_turns from conversations group by 1")
def d05_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"), F.count("*").alias("n_turns"))


@query("select source, string_agg(lang, ',' order by lang) as langs from (select source, lang from documents group by 1, 2 having count(*) > 1) group by 1")
def d06_dup_and_stops(spark: SparkSession, sf: str) -> DataFrame:
    twice = load(spark, sf, "documents").groupBy("source", "lang").count().filter("count > 1")
    return twice.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("select * from (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) where k <= 3")
def f02_first_k(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return load(spark, sf, "documents").select("doc_id", "source", F.row_number().over(w).cast("long").alias("k")).filter("k <= 3")


@query(f"""select doc_id, field, after as value from ({_FIXED}) where doc_id % 10 <> 0 union all select doc_id, field, value from ({_NOISY}) where doc_id % 10 = 0""")
def s01_union_corrected(spark: SparkSession, sf: str) -> DataFrame:
    before = noisy_cells(spark, sf)
    fixed = rules.corrected(before.filter("doc_id % 10 <> 0"), [("number", "numeric", "[0-9]{5}$"), ("date", "date", None)])
    return fixed.unionByName(before.filter("doc_id % 10 = 0")).orderBy("doc_id", "field")
