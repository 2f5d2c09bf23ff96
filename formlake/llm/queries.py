"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm import chat_format, filter_audit, line_dedup, mixing, packing, quality_classifier, quality_rules, rans, simhash_dedup, token_counts, topk_search, url_filter, whitening
from formlake.llm.work import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    failed = ~quality_rules.passes(quality_rules.BASE)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & quality_rules.passes(quality_rules.CURRENT)})


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version decides alone, from the stored bits."""
    return quality_rules.ablations(materialise(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.new_token_file(spark)
    rans.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    n = (F.octet_length("ids") / 4).cast("long")
    return rans.read_token_file(spark, path).select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    out = chat_format.format_chats(rows).withColumns({"turns": chat_format.read_turns(), "loss": chat_format.read_loss_text()})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")} | {"llm_rule_ablations": rule_ablations}


_BLANK = r"[^\x20\x09-\x0D]"

_OP3 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings where vec_id is not null and embedding is not null
and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 20"""

_OP4 = (
    rf"""with d as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, t, regexp_extract_all(t, '{_BLANK}+') as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_BLANK}')) as ls from d),
p as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)), f as (select doc_id, g from p group by 1, 2 having count(*) > 1),
c as (select doc_id, count(distinct i + j) as n from p join f using (doc_id, g), range(5) o(j) group by 1),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
(len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') and not regexp_matches(x, '[a-z]')))::bigint as n_upper_words, ((length(t) - length(replace(t, '!!', ''))) // 2)::bigint as n_shouts,
len(list_filter(ws, lambda x: x = '|'))::bigint as n_bars, length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g'))::bigint as n_letters,
len(list_filter(list_zip(ws, ws[2:]), lambda z: z[1] = z[2]))::bigint as n_stutters from w left join c using (doc_id)),
r as (select *, ("""
    + " + ".join(f"case when {rule} then {1 << k} else 0 end" for k, rule in enumerate(quality_rules.RULES.values()))
    + ")::bigint as failed from m) select *, failed & 3 <> 0 as base_failed, failed = 0 as kept from r"
)

_NAMES = list(quality_rules.RULES)
_ABLATIONS = (
    _OP4.replace("select *, failed & 3 <> 0 as base_failed, failed = 0 as kept from r", "")
    + ", t(version, mask, rule, bit) as (values "
    + ", ".join(f"('{p.version}', {p.mask()}, '{r}', {1 << _NAMES.index(r)})" for p in quality_rules.POLICIES for r in p.rules)
    + """) select version, rule, count(*) filter (failed & mask = 0) as n_kept, count(*) filter (failed & mask & ~bit = 0) as n_kept_without,
count(*) filter (failed & mask = bit) as only_failure from r cross join t group by 1, 2"""
)

_OP7 = r"""with c as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n as (select *, case when r = lag(r) over (partition by conv_id order by turn, r, x) then 7 else 14 + length(r) end + length(x) + length(x) - length(replace(x, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(x, '#+'), lambda h: length(h) - 1)), 0)
+ (2 * length(x) - length(replace(x, '</turn>', '')) - length(replace(x, '<turn/>', ''))) // 7 as size from c)
select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) as turns_sha256, coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint as loss_chars,
sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '')) as loss_sha256, sum(size)::bigint as formatted_chars from n group by 1"""


_OP11 = r"""with m as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
f as (select doc_id, part, (case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end
+ case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when coalesce(min(doc_id) over (partition by t) < doc_id, false) then 16 else 0 end)::int as failed from m),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by 1),
p as (select part, failed, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n from f left join l using (doc_id) group by all),
c as (select chr((65 + i)::int) as name, (1 << i)::int as bit from range(5) x(i)),
o as (select a.name || b.name || d.name || e.name || g.name as filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] as bits from c a, c b, c d, c e, c g where a.bit | b.bit | d.bit | e.bit | g.bit = 31),
w as (select part, filter_order, step::int as step, bits[step] as bit, failed, good, toxic, n, coalesce(list_position(list_transform(bits, lambda x: failed & x <> 0), true), 6) as first from p, o, range(1, 6) s(step)),
r as (select part, filter_order, step, bit, coalesce(sum(n) filter (first > step), 0)::bigint as kept, coalesce(sum(n) filter (first = step), 0)::bigint as removed, coalesce(sum(n) filter (first < step and failed & bit <> 0), 0)::bigint as redundant,
coalesce(sum(n) filter (failed = bit), 0)::bigint as unique_fails, coalesce(sum(n) filter (first = step and good = 1), 0)::bigint as good_lost, coalesce(sum(n) filter (first = step and toxic = 1), 0)::bigint as toxic_lost from w group by 1, 2, 3, 4)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r"""


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other operators' hashes, models, codes and searches for components are beyond SQL."""
    return {"op3_topk_search": _OP3, "op4_quality_rules": _OP4, "llm_rule_ablations": _ABLATIONS, "op7_chat_format": _OP7, "op11_filter_audit": _OP11}
