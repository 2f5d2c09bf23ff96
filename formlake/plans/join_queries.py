"""Queries over similarity, interval and neighbour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import geometry
from formlake.operators import flags, matching, ordered
from formlake.plans.registry import query
from formlake.session import load


@query("""with v as (select distinct lower(r) as v from (select case when p_partkey % 2 = 0 then replace(p_name, 'a', 'o') else p_name end as r from part)), e as (select e, row_number() over (order by e) as o from (select distinct lower(p_name) as e from part)),
m as (select v, e, o, levenshtein(v, e) as d from v, e where levenshtein(v, e) <= floor(0.25 * length(v)))
select v as value, arg_min(e, d * 100000 + o) as entry, min(d) as distance from m group by v""")
def j01_theta_best(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    values = part.select(F.lower(F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit("a"), F.lit("o"))).otherwise(F.col("p_name"))).alias("value"))
    from formlake.sources.lists import sorted_lexicon

    entries = sorted_lexicon(part.select(F.lower("p_name").alias("e")), "e")
    return matching.nearest_entries(values, entries, 0.25).withColumn("distance", F.col("distance").cast("long"))


@query(f"""with b as (select vec_id, label, (select sum(case when x > 0 then 1::ubigint << (i - 1)::int else 0 end)::ubigint from (select unnest(embedding) as x, generate_subscripts(embedding, 1) as i)) as code from embeddings),
m as (select l.vec_id as a, r.vec_id as b, bit_count(xor(l.code, r.code)) as distance from b l, b r where l.label = r.label and l.vec_id % 2 = 0 and r.vec_id % 2 = 1),
k as (select *, row_number() over (partition by a order by distance, b) as x, row_number() over (partition by b order by distance, a) as y from m)
select a, b, distance::bigint as distance from k where x = 1 and y = 1""")
def j02_mutual_nn(spark: SparkSession, sf: str) -> DataFrame:
    code = F.aggregate(F.transform(F.col("embedding"), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    e = load(spark, sf, "embeddings").select("vec_id", "label", code.alias("code"))
    left = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("code").alias("ca"))
    right = e.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("code").alias("cb"))
    out = matching.mutual_nearest(left, right, F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))), "a", "b", F.col("la") == F.col("lb"))
    return out.withColumn("distance", F.col("distance").cast("long"))


@query("""with t as (select l_orderkey as doc_id, l_linenumber as pos, (l_linenumber - 1) * 10 as ts, l_linenumber * 10 as te, -l_discount as logp from lineitem), s as (select o_orderkey as doc_id, 'f' as field, 5 as s, 5 + (o_orderkey % 30)::int as e from orders)
select s.doc_id, s.field, count(logp) as n_tokens, round(exp(min(logp)), 6) as conf_min, round(exp(arg_min(logp, pos)), 6) as conf_first, round(exp(avg(logp)), 6) as conf_mean from s left join t on t.doc_id = s.doc_id and ts < e and te > s group by 1, 2""")
def j03_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    place = F.struct(n, F.col("_metadata.file_path"), F.col("_metadata.row_index"))  # line numbers repeat within an order: of equal ones the first in the table counts
    tokens = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), place.alias("pos"), ((n - 1) * 10).alias("ts"), (n * 10).alias("te"), (-F.col("l_discount")).alias("logp"))
    spans = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("f").alias("field"), F.lit(5).alias("s"), (5 + F.col("o_orderkey") % 30).cast("int").alias("e"))
    out = flags.span_confidence(spans, tokens)
    return out.select("doc_id", "field", "n_tokens", *[F.round(c, 6).alias(c) for c in ("conf_min", "conf_first", "conf_mean")])


@query("""with b as (select l_orderkey as k, l_linenumber as n, l_quantity as y0, l_quantity + 5 + l_linenumber as y1 from lineitem)
select l.k, l.n as a, r.n as b, round(greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) / least(l.y1 - l.y0, r.y1 - r.y0), 6) as share from b l join b r on l.k = r.k and l.n < r.n
where greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) / least(l.y1 - l.y0, r.y1 - r.y0) >= 0.3""")
def j04_vertical_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 5 + F.col("l_linenumber")).alias("y1"))
    r = b.select("k", F.col("n").alias("b"), F.col("y0").alias("z0"), F.col("y1").alias("z1"))
    share = geometry.overlap_share(F.col("y0"), F.col("y1"), F.col("z0"), F.col("z1"))
    met = b.withColumnRenamed("n", "a").join(r, "k").filter("a < b").withColumn("share", share)
    return met.filter("share >= 0.3").select("k", "a", "b", F.round("share", 6).alias("share"))


@query("""with p as (select l_orderkey as k, l_linenumber as n, l_quantity as x, l_tax * 100 as y, l_linenumber % 2 as m from lineitem)
select k, marker, option from (select a.k, a.n as marker, b.n as option, row_number() over (partition by a.k, a.n order by abs(a.x - b.x) + abs(a.y - b.y), b.n) as r from p a join p b on a.k = b.k and a.m = 0 and b.m = 1) where r = 1""")
def j05_nearest_l1(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    even, odd = p.filter("n % 2 = 0").withColumnRenamed("n", "marker"), p.filter("n % 2 = 1").withColumn("ord", F.col("n")).withColumnRenamed("n", "option")
    return matching.nearest_option(even, odd, "k")


@query("""select doc_id, label, regexp_matches(text, '^(' || label || ')([\\s,.]|$)') as anchored from documents, (values ('The'), ('Der'), ('Les'), ('In')) l(label) where regexp_matches(text, '(^|\\s)(' || label || ')([\\s,.]|$)')""")
def j06_regex_label_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.createDataFrame([(x, rf"^({x})([\s,.]|$)", rf"(^|\s)({x})([\s,.]|$)") for x in ("The", "Der", "Les", "In")], "label string, prefix_re string, strict_re string")
    return matching.label_hits(load(spark, sf, "documents").withColumn("ord", F.lit(0)), labels, "doc_id").select("doc_id", "label", "anchored")


@query("""with c as (select doc_id, source as field, lang as value from documents), e as (select distinct source as field, 'en' as value from documents where source like 'src1%')
select field, count(*) filter (value <> '') as n_filled, count(*) filter (value <> '' and h) as n_hits, round(count(*) filter (value <> '' and h) / nullif(count(*) filter (value <> ''), 0), 6) as rate, min(case when h then value end) as example
from (select c.*, e.field is not null as h from c left join e on c.field = e.field and c.value = e.value) group by 1""")
def j07_bleed(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    cells = docs.select("doc_id", F.col("source").alias("field"), F.col("lang").alias("value"))
    shown = docs.filter("source like 'src1%'").select(F.col("source").alias("field"), F.lit("en").alias("value"))
    return matching.bleed_report(cells, shown)


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as tok, generate_subscripts(string_split(text, ' '), 1) as pos from documents)
select doc_id, pos - 1 as pos, (sum(length(tok)) over (partition by doc_id order by pos) - length(tok))::bigint as s, (sum(length(tok)) over (partition by doc_id order by pos))::bigint as e from w""")
def e09_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "tok"))
    return ordered.token_spans(w, ["doc_id"], "pos", "tok").select("doc_id", F.col("pos").cast("long").alias("pos"), "s", "e")
