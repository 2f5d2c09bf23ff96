"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.operators import closest_pairs, ordered, segmentation
from formlake.plans.registry import query
from formlake.session import load


@query("""with n as (select user_id, event_type, count(*) as n from events group by 1, 2), s as (select *, n / sum(n) over (partition by user_id) as share from n),
k as (select *, row_number() over (partition by user_id order by share desc, event_type) as k from s), t as (select user_id, max(event_type) filter (k = 1) as best, max(share) filter (k = 1) as top, coalesce(max(share) filter (k = 2), 0) as second from k group by 1)
select user_id, best, round(top, 6) as top, round(second, 6) as second, round((top - second) / (top + 1e-6), 6) as margin, case when top < 0.02 then 'no_mark' when (top - second) / (top + 1e-6) < 0.15 then 'ambiguous' else 'ok' end as status from t""")
def e01_top2_margin(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).withColumnRenamed("event_type", "option").withColumn("ord", F.col("option"))
    out = ordered.marked_option(shares, ["user_id"])
    return out.select("user_id", "best", *[F.round(c, 6).alias(c) for c in ("top", "second", "margin")], "status")


_PROFILE = "select vec_id, i - 1 as i, floor(x * 1000)::int as v from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)"


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, p): an embedding as an ink profile of integers."""
    return load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("p"))


def points(rows: DataFrame, column: str = "p") -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("i", "v"))


@query(f"""with p as ({_PROFILE}), q as (select p.vec_id, p.i, o.k, least(63, greatest(0, p.i + o.k)) as j from p, (values (-2), (-1), (0), (1), (2)) o(k))
select q.vec_id, q.i, round(sum(p.v) / 5, 6) as mean from q join p on p.vec_id = q.vec_id and p.i = q.j group by 1, 2""")
def e02_moving_average_edge(spark: SparkSession, sf: str) -> DataFrame:
    smooth = profile(spark, sf).select("vec_id", ordered.moving_average(F.col("p"), 5).alias("p"))
    return points(smooth).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("mean"))


_MAXIMA = f"""select vec_id, i from (select *, lag(v, 1, -1000000) over (partition by vec_id order by i) as l, lead(v, 1, -1000000) over (partition by vec_id order by i) as r from ({_PROFILE})) where v >= l and v > r"""


@query(_MAXIMA)
def e03_local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf).select("vec_id", F.explode(F.transform(ordered.local_maxima(F.col("p")), lambda i: i.cast("long"))).alias("i"))


@query(f"""with p as ({_PROFILE}), k as (select m.vec_id, m.i, p.v from ({_MAXIMA}) m join p on p.vec_id = m.vec_id and p.i = m.i),
r as (select k.vec_id, k.i, k.v, coalesce(max(p.i) filter (p.i < k.i and p.v > k.v), -1) as l, coalesce(min(p.i) filter (p.i > k.i and p.v > k.v), 999) as h from k join p on p.vec_id = k.vec_id group by 1, 2, 3)
select r.vec_id, r.i, (r.v - greatest(min(p.v) filter (p.i <= r.i), min(p.v) filter (p.i >= r.i)))::double as prominence from r join p on p.vec_id = r.vec_id and p.i > r.l and p.i < r.h group by r.vec_id, r.i, r.v""")
def e04_prominence(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.prominences(F.col("p"))
    return profile(spark, sf).select("vec_id", F.inline(found)).withColumn("i", F.col("i").cast("long"))


@query("""with d as (select o_custkey, epoch(o_orderdate)::bigint // 86400 as day from orders), g as (select *, case when day - lag(day) over (partition by o_custkey order by day) > 30 then 1 else 0 end as f from d), i as (select *, sum(f) over (partition by o_custkey order by day range unbounded preceding) as island from g)
select o_custkey, island::bigint as island, min(day) as low, max(day) as high, count(*) as n from i group by 1, 2""")
def e05_islands(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "orders").select("o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return ordered.islands(days, ["o_custkey"], "day", 30)


@query(f"""with p as ({_PROFILE}), k as (select vec_id, i as l, lead(i) over (partition by vec_id order by i) as r from ({_MAXIMA})), m as (select k.vec_id, k.l, k.r, p.i, row_number() over (partition by k.vec_id, k.l order by p.v, p.i) as n from k join p on p.vec_id = k.vec_id and p.i between k.l and k.r where k.r is not null)
select vec_id, l as "left", r as "right", i as cut from m where n = 1""")
def e06_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    out = profile(spark, sf).select("vec_id", F.inline(ordered.boundaries(F.col("p"))))
    return out.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("left", "right", "cut")])


@query("""with m as (select conv_id, turn, coalesce(text, '') as text, turn % 3 = 0 as head from conversations), f as (select *, case when lag(head) over w is distinct from head and row_number() over w > 1 then 1 else 0 end as n from m window w as (partition by conv_id order by turn)), r as (select *, sum(n) over (partition by conv_id order by turn) as run from f)
select conv_id, run::bigint as run, head, string_agg(text, ' ' order by turn) as text, count(*) as n from r group by 1, 2, 3""")
def e07_continuation(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 3 == 0).alias("head"))
    return ordered.continued(rows, ["conv_id"], "turn", "head", "text")


@query("""select conv_id, turn, (select min(b.turn) from conversations b where b.conv_id = a.conv_id and b.turn > a.turn and b.role = 'assistant') as answer from conversations a where role = 'user'""")
def e08_next_non_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = ordered.next_matching(rows, ["conv_id"], "turn", F.col("turn"), F.col("role") == "assistant", "answer")
    return out.filter("role = 'user'").select("conv_id", "turn", "answer")


@query("""select a, b, d from (select l.vec_id as a, r.vec_id as b, round(sqrt(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 6) as d from embeddings l join embeddings r on l.label = r.label and l.vec_id < r.vec_id ) order by d, a, b limit 500""")
def f01_topk_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = closest_pairs.candidates(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", 500)
    return found.select("a", "b", F.round("d", 6).alias("d")).orderBy(F.asc_nulls_last("d"), "a", "b").limit(500)


_HEIGHTS = "(select vec_id, list((floor(x * 1000) + 600)::double order by i) as p from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1)"


@query(f"""with recursive q as (select vec_id, p, list_filter(range(len(p)), lambda i: (i = 0 or p[i + 1] >= p[i]) and (i = len(p) - 1 or p[i + 1] > p[i + 2])) as peaks from {_HEIGHTS}),
m as (select vec_id, p, peaks, 0 as k from q union all
select vec_id, p, list_filter(peaks, lambda x: x <> case when p[peaks[w] + 1] < p[peaks[w + 1] + 1] then peaks[w] else peaks[w + 1] end) as peaks, k + 1 as k from (
select *, list_position(r, list_max(r)) as w from (select *, list_transform(range(1, len(peaks)), lambda i: list_min(p[peaks[i] + 1:peaks[i + 1] + 1]) / least(p[peaks[i] + 1], p[peaks[i + 1] + 1])) as r from m)) where len(r) > 0 and list_max(r) > 0.5),
f as (select vec_id, p, arg_max(peaks, k) as peaks from m group by 1, 2), d as (select *, list_median(list_transform(range(1, len(peaks)), lambda i: peaks[i + 1] - peaks[i])) as pitch from f),
s as (select vec_id, p, case when len(peaks) <= 2 then peaks else list_reduce(list_transform(peaks, lambda x: [x]), lambda a, b: case when b[1] - a[-1] >= 0.6 * pitch then a || b when p[b[1] + 1] > p[a[-1] + 1] then a[1:len(a) - 1] || b else a end) end as peaks from d)
select vec_id, x.peak::int as peak, (1 + coalesce(list_max(list_filter(range(peak), lambda i: p[i + 1] <= 0.7 * p[peak + 1])), -1))::int as top, coalesce(list_min(list_filter(range(peak + 1, len(p)), lambda i: p[i + 1] <= 0.7 * p[peak + 1])), len(p))::int as bottom from s, unnest(peaks) x(peak)""")
def e10_merged_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of a profile after shallow valleys are merged and distances enforced, with the band around each."""
    rows = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double") + 600).alias("p"))
    rows = rows.withColumn("i", ordered.local_maxima(F.col("p")))
    rows = rows.withColumn("i", segmentation.merged_peaks(F.col("p"), F.col("i"), 0.5))
    rows = rows.withColumn("i", segmentation.spaced_peaks(F.col("p"), F.col("i"), 0.6))
    each = F.arrays_zip(F.col("i").alias("peak"), segmentation.peak_bands(F.col("p"), F.col("i"), 0.7).alias("band"))
    return rows.select("vec_id", F.explode(each).alias("x")).select("vec_id", F.col("x.peak").alias("peak"), "x.band.top", "x.band.bottom")
