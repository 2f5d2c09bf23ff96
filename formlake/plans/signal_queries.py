"""Queries over ink statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.operators import segmentation, signal
from formlake.plans.registry import query
from formlake.session import load

_LEVELS = "select vec_id, label, i - 1 as i, least(255, greatest(0, floor((x + 0.5) * 255)))::int as level from (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)"


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, i, level): embeddings as grey levels."""
    e = load(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.5) * 255))).cast("int")
    return e.select("vec_id", "label", "i", level.alias("level"))


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return signal.otsu(levels(spark, sf).groupBy("label", "level").agg(F.count("*").alias("n")), ["label"])


_OTSU = f"""with h as (select label, level, count(*) as n from ({_LEVELS}) group by 1, 2), r as (select *, sum(n) over w as n0, sum(level * n) over w as w0, sum(n) over (partition by label) as na, sum(level * n) over (partition by label) as wa from h window w as (partition by label order by level)),
s as (select label, level, case when na > n0 then round((wa * n0 - w0 * na)::double * (wa * n0 - w0 * na)::double / (n0 * (na - n0)), 6) else -1 end as s from r)
select label, level as threshold from (select *, row_number() over (partition by label order by s desc, level) as k from s) where k = 1"""


@query(_OTSU)
def g01_otsu(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds(spark, sf)


@query(f"""select label, round(median(level), 6) as median, round(quantile_cont(level, 0.95), 6) as p95, min(level) as low, count(distinct level) as n_distinct, round(quantile_cont(level, 0.95), 6) - min(level) >= 25 as has_contrast from ({_LEVELS}) group by 1""")
def g02_pooled_stats(spark: SparkSession, sf: str) -> DataFrame:
    return signal.pooled(levels(spark, sf), ["label"], "level", 25)


@query(f"""with t as ({_OTSU}) select l.vec_id, round(avg(case when l.level <= t.threshold then 1 else 0 end), 6) as ink from ({_LEVELS}) l join t on t.label = l.label group by 1""")
def g03_ink_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = levels(spark, sf).groupBy("vec_id", "label").agg(F.collect_list("level").alias("p"))
    return e.join(thresholds(spark, sf), "label").select("vec_id", F.round(signal.ink_ratio(F.col("p"), F.col("threshold")), 6).alias("ink"))


@query(f"select label, i, sum(level)::bigint as ink from ({_LEVELS}) group by 1, 2")
def g04_row_profile(spark: SparkSession, sf: str) -> DataFrame:
    return signal.row_profile(levels(spark, sf), ["label"], "i", "level").withColumn("i", F.col("i").cast("long"))


@query("select l_orderkey, min(l_quantity) as x1, min(l_tax) as y1, max(l_quantity + 5) as x2, max(l_tax + 1) as y2 from lineitem group by 1")
def g05_union_bbox(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x1"), F.col("l_tax").alias("y1"), (F.col("l_quantity") + 5).alias("x2"), (F.col("l_tax") + 1).alias("y2"))
    return signal.union_box(b, ["l_orderkey"])


@query("select l_returnflag, min(l_quantity) filter (l_linestatus = 'O') as low_marked, max(l_quantity) filter (l_linestatus <> 'O') as high_unmarked, coalesce(min(l_quantity) filter (l_linestatus = 'O') <= max(l_quantity) filter (l_linestatus <> 'O'), false) as overlaps from lineitem group by 1")
def d03_overlap_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").withColumn("marked", F.col("l_linestatus") == "O")
    return signal.overlap_test(rows, ["l_returnflag"], "l_quantity", "marked")


_CROPS = """with e as (select vec_id, i - 1 as i, least(255, greatest(0, floor((x::double + 0.5) * 255)))::int as v from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings)),
p as (select vec_id, i // 16 as o, i % 16 // 4 as y, i % 4 as x, case vec_id % 5 when 0 then case when v < 110 then 0 else 255 end when 1 then 200 + v // 64 when 2 then 255 - v // 2 when 3 then case when v < 100 then v when v < 140 then 255 else 254 end else v end as v from e)"""


def crops(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, option, ord, gray): each embedding as four option crops of 4 by 4 pixels: two levels, hardly any contrast, light ones, extremes, or as it is."""
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.5) * 255))).cast("int")
    kinds = [F.when(v < 110, 0).otherwise(255), 200 + F.floor(v / 64), 255 - F.floor(v / 2), F.when(v < 100, v).when(v < 140, 255).otherwise(254), v]
    drawn = F.col("vec_id") % 5
    level = F.coalesce(*[F.when(drawn == k, c.cast("int")) for k, c in enumerate(kinds)])
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", level.alias("v"))
    whole = e.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p"))
    rows = lambda k: F.array(*[F.slice("p", 16 * k + 4 * y + 1, 4) for y in range(4)])
    each = F.array(*[F.struct(F.lit("abcd"[k]).alias("option"), F.lit(k).alias("ord"), rows(k).alias("gray")) for k in range(4)])
    return whole.select("vec_id", F.inline(each))


@query(f"""{_CROPS}, h as (select vec_id, v as level, count(*) as n from p group by 1, 2),
r as (select *, sum(n) over w as n0, sum(level * n) over w as w0, sum(n) over (partition by vec_id) as na, sum(level * n) over (partition by vec_id) as wa from h window w as (partition by vec_id order by level)),
u as (select vec_id, level as otsu from (select *, row_number() over (partition by vec_id order by case when na > n0 then round((wa * n0 - w0 * na)::double * (wa * n0 - w0 * na)::double / (n0 * (na - n0)), 6) else -1 end desc, level) as k from r) where k = 1),
s as (select vec_id, quantile_cont(v, 0.95) as paper, min(v) as low, count(distinct v) as d, sum(distinct v) as two_levels from p group by 1),
t as (select vec_id, case when paper - low < 25 or d < 2 then null when d = 2 then two_levels / 2 when otsu <= 0 or otsu >= 254 then (paper + low) / 2 else otsu end::double as threshold from s join u using (vec_id)),
m as (select vec_id, o, y, x, coalesce(v <= threshold, false) as ink, threshold from p join t using (vec_id)),
a as (select m.vec_id, m.o, m.y, m.x, any_value(m.threshold) as threshold, bool_and(n.ink) as ink from m join m n on m.vec_id = n.vec_id and m.o = n.o and n.y between m.y - 1 and m.y and n.x between m.x - 1 and m.x group by 1, 2, 3, 4),
b as (select a.vec_id, a.o, a.y, a.x, any_value(a.threshold) as threshold, bool_or(n.ink) as ink from a join a n on a.vec_id = n.vec_id and a.o = n.o and n.y between a.y - 1 and a.y and n.x between a.x - 1 and a.x group by 1, 2, 3, 4),
i as (select vec_id, o, any_value(threshold) as threshold, count(*) filter (ink) / 16 as share from b group by 1, 2), k as (select *, row_number() over (partition by vec_id order by share desc, o) as k from i),
g as (select vec_id, any_value(threshold) as threshold, max(chr((97 + o)::int)) filter (k = 1) as best, max(share) filter (k = 1) as top, max(share) filter (k = 2) as second, max(share) filter (o = 0) as a, max(share) filter (o = 1) as b, max(share) filter (o = 2) as c, max(share) filter (o = 3) as d from k group by 1),
z as (select *, (top - second) / (top + 1e-6) as margin, case when top < 0.02 then 'no_mark' when (top - second) / (top + 1e-6) < 0.15 then 'ambiguous' else 'ok' end as status from g)
select vec_id, case when status = 'ok' then best end as selected, status, round(margin, 4) as margin, round(threshold, 1) as threshold, round(a, 4) as ink_a, round(b, 4) as ink_b, round(c, 4) as ink_c, round(d, 4) as ink_d from z""")
def g10_checkbox_report(spark: SparkSession, sf: str) -> DataFrame:
    """Ink of options under one threshold per group, opened masks, and a column for each option."""
    return signal.checkbox_report(signal.ink_shares(crops(spark, sf), ["vec_id"]), ["vec_id"])


_GRID = "select vec_id, (i - 1) // 8 as y, (i - 1) % 8 as x from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) where v > 0.02"


def ink_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as crops of 8 by 8 pixels, ink where a component is above 0.02."""
    return load(spark, sf, "embeddings").select("vec_id", F.lit(8).alias("w"), F.transform("embedding", lambda x: (x.cast("double") > 0.02).cast("int")).alias("ink"))


_COMPONENTS = f"""with recursive p as ({_GRID}), g as (select vec_id, y, x, y * 8 + x as m, 0 as k from p union all
select vec_id, y, x, m, k from (select g.vec_id, g.y, g.x, least(g.m, (select min(n.m) from g n where n.vec_id = g.vec_id and abs(n.y - g.y) <= 1 and abs(n.x - g.x) <= 1)) as m, g.k + 1 as k from g) where k <= 32),
c as (select vec_id, y, x, m as c from g where k = 32)"""


@query(_COMPONENTS + " select vec_id, count(distinct c) as n_components, count(*) as ink, (select max(n) from (select count(*) as n from c d where d.vec_id = c.vec_id group by d.c)) as largest from c group by vec_id")
def g11_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected ink of every crop: how many pieces, and how large."""
    runs = segmentation.ink_runs(ink_grids(spark, sf), "vec_id").groupBy("vec_id", "component").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    return runs.groupBy("vec_id").agg(F.count("*").alias("n_components"), F.sum("n").alias("ink"), F.max("n").alias("largest"))


@query(_COMPONENTS + """, l(line, t, b, bt, bb, peak) as (values (0, 0, 4, 1, 3, 1), (1, 4, 8, 5, 7, 6)), v as (select vec_id, c, line, count(*) filter (y >= bt and y < bb) as body from c join l on y >= t and y < b group by 1, 2, 3),
o as (select vec_id, c, case when max(body) > 0 then max(line) filter (body = mb) end as owner from (select *, max(body) over (partition by vec_id, c) as mb from v) group by 1, 2),
s as (select vec_id, c, min(x) as l, max(x) + 1 as r, min(y) as t, max(y) + 1 as b, avg(y) as cy from c group by 1, 2), f as (select s.*, owner from s join o using (vec_id, c)),
n as (select a.vec_id, a.c, first(z.owner order by greatest(z.t - a.b, a.t - z.b), z.c) as near from f a join f z on a.vec_id = z.vec_id and a.owner is null and z.owner is not null and z.r > a.l and z.l < a.r group by 1, 2),
w as (select f.vec_id, f.c, coalesce(owner, near, case when abs(cy - 1) <= abs(cy - 6) then 0 else 1 end) as line from f left join n on n.vec_id = f.vec_id and n.c = f.c)
select c.vec_id, w.line, count(*) as ink, sum(y * 8 + x)::bigint as place from c join w on w.vec_id = c.vec_id and w.c = c.c group by 1, 2""")
def g12_lines_of_components(spark: SparkSession, sf: str) -> DataFrame:
    """Ink by the line its component belongs to: votes in the bands, dots by their neighbours, else by the nearest peak."""
    crops_ = ink_grids(spark, sf)
    windows = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("line", "top", "bottom", "band_top", "band_bottom", "peak"), w, strict=True)]) for w in ((0, 0, 4, 1, 3, 1), (1, 4, 8, 5, 7, 6))]))
    runs = segmentation.assigned_runs(segmentation.ink_runs(crops_, "vec_id"), crops_.select("vec_id", windows), "vec_id")
    n = F.col("x1") - F.col("x0")
    return runs.groupBy("vec_id", "line").agg(F.sum(n).alias("ink"), F.sum(n * F.col("y") * 8 + (F.col("x0") + F.col("x1") - 1) * n / 2).cast("long").alias("place"))


@query(f"""with recursive p as (select vec_id, (i - 1) // 8 as y, (i - 1) % 8 as x, case when v > 0.02 then 1.0 else 0.0 end + 0.03 * abs((i - 1) // 8 - 4) / 8 as cost from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)),
s as (select vec_id, y, 0 as x, cost from p where x = 0 union all select p.vec_id, p.y, p.x, p.cost + (select min(q.cost) from s q where q.vec_id = p.vec_id and q.y between p.y - 1 and p.y + 1) from p join (select distinct vec_id, x from s) k on p.vec_id = k.vec_id and p.x = k.x + 1)
select vec_id, round(min(cost), 6) as cost, 8 as n_steps, true as told from s where x = 7 group by 1""")
def g13_seam(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest way through a crop, and that its path has a row for each column and just this cost."""
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.get("ink", y * 8 + x)))
    rows = ink_grids(spark, sf).select("vec_id", segmentation.seam_cost(columns, 4, 0.03).alias("c"))
    rows = rows.select("vec_id", "c", segmentation.seam(F.col("c")).alias("s"))
    walked = F.aggregate(F.zip_with("c", "s.path", lambda c, y: F.get(c, y)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round("s.cost", 6).alias("cost"), F.size("s.path").alias("n_steps"), (F.abs(walked - F.col("s.cost")) < 1e-9).alias("told"))
