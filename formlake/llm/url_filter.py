"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones; trees judge the others by
length, depth, digit ratio, entropy, parameter counts and statistics of suffixes
(how many labelled URLs have the same host suffix, file suffix or first folder,
and how often they are blocked). Suffix statistics are taken over all labelled
rows. The trees are fitted on a bounded sample of distinct labelled URLs
(``sample``, by seeded hash), each with the statistics of hosts outside its own
fold, so that no URL sees its own label. Every tree draws rows and features, so
that no single feature decides alone.

Features are column expressions and scoring runs in the JVM. Statistics are
pre-aggregated and stored; their joins broadcast them only where Spark knows
their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.work import materialise

SAMPLE = 20_000
FOLDS = 5
_PRIOR = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUFFIXES = ("top_suffix", "domain_suffix", "file_suffix", "first_folder")
_LEXICAL = ("n_url", "n_host", "n_path", "depth", "digits", "entropy", "n_parameters", "n_values", "n_dots", "n_hyphens", "fragment", "secure")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where ``://`` is missing."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of rules as long the one with the longer host.

    A rule ``host/path`` fits its host and all its subdomains where the path
    starts with the rule's. Rules become one expression: meant for hundreds.
    """
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[0])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col(host) == own) | F.col(host).endswith(f".{own}")) & F.col(path).startswith(start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _features(rows: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``."""
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    signs = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return rows.withColumn("_url", F.coalesce("url", F.lit(""))).withColumns(
        {
            "n_url": F.length(url),
            "n_host": F.length(host),
            "n_path": F.length(path),
            "depth": F.regexp_count(path, F.lit("/")),
            "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
            "entropy": F.when(url == "", 0.0).otherwise(F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))),
            "n_parameters": F.regexp_count(query, F.lit("[^&]+")),
            "n_values": F.regexp_count(query, F.lit("=[^&]")),
            "n_dots": F.regexp_count(host, F.lit("[.]")),
            "n_hyphens": F.regexp_count(url, F.lit("-")),
            "fragment": F.instr(url, "#") > 0,
            "secure": url.startswith("https:"),
            "top_suffix": F.element_at(labels, -1),
            "domain_suffix": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), "."),
            "file_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
            "first_folder": F.regexp_extract(path, r"^/([^/]*)/", 1),
        }
    ).withColumns({c: F.col(c).cast("double") for c in _LEXICAL})


_COUNTS = [f"{k}{f}" for k in ("n", "bad") for f in range(FOLDS)]


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(kind, suffix, n0.., bad0..): labelled and blocked rows of each suffix by fold of their hosts.

    Takes the suffixes, ``label`` and ``fold`` of every labelled row. The kind
    ``all`` counts all rows.
    """
    kinds = [F.struct(F.lit("all").alias("kind"), F.lit("").alias("suffix")), *(F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in _SUFFIXES)]
    each = labelled.select(F.explode(F.array(*kinds)).alias("s"), "label", "fold").select("s.*", "label", "fold")
    counts = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)]
    counts += [F.count_if((F.col("fold") == f) & (F.col("label") == 1)).alias(f"bad{f}") for f in range(FOLDS)]
    return each.groupBy("kind", "suffix").agg(*counts)


def _with_statistics(rows: DataFrame, stats: DataFrame, overall: float, out_of_fold: bool) -> DataFrame:
    """Smoothed rate and count of each suffix, over all folds or all but the row's own."""

    def total(k: str) -> Column:
        parts = [F.coalesce(F.col(f"{k}{f}"), F.lit(0)) for f in range(FOLDS)]
        return sum((F.when(F.col("fold") == f, 0).otherwise(p) if out_of_fold else p for f, p in enumerate(parts)), F.lit(0))

    for kind in _SUFFIXES:
        own = stats.filter(F.col("kind") == kind).select(F.col("suffix").alias("_s"), *_COUNTS)
        rows = rows.join(own, F.col(kind) == F.col("_s"), "left")
        rows = rows.withColumns({f"{kind}_rate": (total("bad") + _PRIOR * overall) / (total("n") + _PRIOR), f"{kind}_count": F.log1p(total("n"))}).drop("_s", *_COUNTS)
    return rows


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    names = [*_LEXICAL, *(f"{s}_{k}" for s in _SUFFIXES for k in ("rate", "count"))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def training_vectors(labelled: DataFrame, stats: DataFrame, overall: float, sample: int) -> DataFrame:
    """(features, label, host) of at most ``sample`` distinct labelled URLs, those with the smallest seeded hashes.

    Hashes are looked for first, so that a URL of many copies counts once and
    only hashes are shuffled. The rows come in one order, which the trees' draws
    rest on.
    """
    edge = labelled.select("_order").distinct().orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    drawn = labelled.filter(F.col("_order") <= F.lit(edge)).dropDuplicates(["_order"])
    out = _vectors(_with_statistics(drawn, stats, overall, out_of_fold=True))
    return out.select("features", "label", "host", "_order").repartition(1).sortWithinPartitions("_order")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", id_col: str = "page_id", sample: int = SAMPLE, seed: int = 2) -> DataFrame:
    """One row per input row: (id, host, path, rule, verdict, score).

    ``rule``: the rule that decided, else null; ``verdict``: ``allow`` or
    ``block``, the rule's, else the trees'; ``score``: their chance of
    ``block``, null where a rule decided. Null and empty URLs have an empty
    host and path and are judged by the trees. Where the labelled rows hold one
    verdict only, that is the method's verdict; without labelled rows it is
    ``allow``. Repeated rows are judged each, a null id stays null, an empty
    table gives an empty result, and other columns are not read.
    """
    from pyspark.ml.functions import vector_to_array

    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("found", longest_rule(rules))
    decided, free = rows.filter("found is not null"), rows.filter("found is null")
    stats, overall, labelled = learned_from(rows, seed)
    if overall is not None and 0 < overall < 1:
        model = boosted_trees(materialise(training_vectors(labelled, stats, overall, sample), "url-vectors"), seed)
        scored = model.transform(_vectors(_with_statistics(_features(free), stats, overall, out_of_fold=False)))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    else:
        scored = free.withColumn("score", F.lit(overall or 0.0))
    shared = [F.col("id").alias(id_col), "host", "path"]
    judged = scored.select(*shared, F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score")
    return decided.select(*shared, "found.rule", "found.verdict", F.lit(None).cast("double").alias("score")).unionByName(judged)


def learned_from(rows: DataFrame, seed: int) -> tuple[DataFrame, float | None, DataFrame]:
    """Suffix statistics, the share of blocked rows (None without labelled rows), and the labelled rows with their features."""
    labelled = _features(rows.filter("found is not null")).withColumns(
        {"label": (F.col("found.verdict") == "block").cast("double"), "fold": F.pmod(F.xxhash64(F.lit(seed), "host"), F.lit(FOLDS)), "_order": F.xxhash64(F.lit(seed), "url")}
    )
    stats = materialise(suffix_statistics(labelled), "url-suffixes")
    n, bad = stats.filter("kind = 'all'").agg(F.sum(sum(F.col(f"n{f}") for f in range(FOLDS))), F.sum(sum(F.col(f"bad{f}") for f in range(FOLDS)))).first()
    return stats, bad / n if n else None, labelled


def boosted_trees(vectors: DataFrame, seed: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
