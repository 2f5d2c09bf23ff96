"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents shrink to one row per membership pattern (the set of sources that
they belong to) and their total size. A flow network routes pattern capacity to
source quotas; every further use of a pattern's documents costs more, so the
cost is convex in repetition and the flow spreads repeats evenly. The flow is
then realised with documents: each pattern orders its documents by a seeded
hash, all of them are used as often as its flow covers the pattern whole, and
the first ones once more. Where the last lies is found through hash bins, so
no pattern is sorted in one task. The document at the edge is used in part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.llm.work import materialise

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_targets(sizes: Sequence[float], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Split ``share`` of all sizes by weight; no target above ``most`` times its size, the excess reshared.

    Sources without size get nothing.
    """
    target = [0.0] * len(sizes)
    free = {i for i, s in enumerate(sizes) if s > 0}
    left = share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free -= over
    return target


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words of each pattern for each of its sources, by successive shortest paths.

    ``capacity``: words of each pattern, ``members``: its sources, ``quota``:
    words wanted by each source. The k-th use of a pattern costs k - 1 a word;
    at most ``repeats`` uses. Quotas that cannot be met are met as far as
    possible.
    """
    n, m = len(capacity), len(quota)
    sink = n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, c: int, price: int) -> None:
        for x, y, r, p in ((a, b, c, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(p)

    for i, c in enumerate(capacity):
        for k in range(repeats):
            arc(0, 1 + i, c, k)
    middle = len(to)
    for i, own in enumerate(members):
        for s in own:
            arc(1 + i, 1 + n + s, repeats * capacity[i], 0)
    stop = len(to)
    for s, q in enumerate(quota):
        arc(1 + n + s, sink, q, 0)
    potential = [0] * len(graph)
    while True:
        far = [math.inf] * len(graph)
        via = [-1] * len(graph)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (y := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = y, e
                    heapq.heappush(heap, (y, to[e]))
        if far[sink] == math.inf:
            break
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, far, strict=True)]
        path = []
        x = sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flow: list[dict[int, int]] = [{} for _ in capacity]
    for e in range(middle, stop, 2):
        if room[e ^ 1]:
            flow[to[e ^ 1] - 1][to[e] - 1 - n] = room[e ^ 1]
    return flow


def select_seeded(sizes: DataFrame, quotas: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Add ``taken`` (words) to ``sizes`` (id, pattern, size, row): the pattern's quota, met in seeded order.

    ``row``, a hash of the text, tells rows without an id apart.

    ``quotas``: (pattern, total, quota), a row per pattern, patterns not null.
    """
    named = F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))
    hashed = sizes.withColumn("_h", F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), F.col("row"), F.col("size"))).otherwise(named)).withColumn("_bin", F.pmod("_h", F.lit(BINS)).cast("int"))
    per_bin = hashed.groupBy("pattern", "_bin").agg(F.sum("size").alias("in_bin"))
    need = quotas.select(F.col("pattern").alias("p"), F.floor(F.col("quota") / F.greatest("total", F.lit(1))).alias("uses"), (F.col("quota") % F.greatest("total", F.lit(1))).alias("rest"))
    before = F.sum("in_bin").over(Window.partitionBy("pattern").orderBy("_bin")) - F.col("in_bin")
    bins = per_bin.withColumn("before", before).join(need, F.col("pattern") == F.col("p"))
    left = F.col("rest") - F.col("before")
    bins = bins.select("p", F.col("_bin").alias("b"), "uses", F.when(left <= 0, 0).when(left >= F.col("in_bin"), 1).otherwise(2).alias("edge"), left.alias("left"))
    joined = hashed.join(bins, (F.col("pattern") == F.col("p")) & (F.col("_bin") == F.col("b"))).drop("p", "b")
    whole = joined.filter("edge < 2").withColumn("taken", F.col("size") * (F.col("uses") + F.col("edge")))
    order = Window.partitionBy("pattern", "_bin").orderBy("_h", id_col, "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum("size").over(order) - F.col("size")  # one bin of each pattern at most
    part = joined.filter("edge = 2").withColumn("_used", used)
    part = part.withColumn("taken", F.col("size") * F.col("uses") + F.least("size", F.greatest(F.col("left") - F.col("_used"), F.lit(0)))).drop("_used")
    return whole.unionByName(part).drop("_h", "_bin", "uses", "edge", "left")


def _memberships(source: str | Column) -> tuple[Column, Column]:
    """A document's sources in order, and the name of this pattern."""
    own = F.array(F.col(source)) if isinstance(source, str) else source
    own = F.array_sort(F.array_distinct(F.coalesce(own, F.array(F.lit(None).cast("string")))))
    return own, F.to_json(F.struct(F.transform(own, lambda s: F.struct(s.alias("s"))).alias("m")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 8, text: str = "text", id_col: str = "doc_id", source: str | Column = "source") -> DataFrame:
    """One row per input row: (id, size, source_size, target, taken).

    Size: words of the text (null: 0). ``source`` names a column, or gives an
    array of the sources of a document, for overlapping ones. Sources take
    ``weights`` in turn in the order of their code points, a null source last;
    ``share`` is the part of all sizes to take, and no target exceeds
    ``repeats`` times its source's size. ``source_size`` and ``target`` belong
    to the document's first source. ``taken``: words that the mix takes,
    repeats counted; a document is used ``repeats`` times at most, and each
    pattern's last document in part. Same rows and seed, same result; rows that
    repeat an id are mixed each; documents without words take nothing; an empty
    table gives an empty result.

    Patterns and sources come to the driver, a row each, not documents.
    """
    return _mixed(docs, weights, share, repeats, seed, text, id_col, source).drop("row", "pattern")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, repeats: int, seed: int, text: str, id_col: str, source: str | Column) -> DataFrame:
    """``mix`` with ``row``, the xxhash64 of the text, and ``pattern``."""
    spark = docs.sparkSession
    own, key = _memberships(source)
    sizes = materialise(docs.select(F.col(id_col).alias(id_col), key.alias("pattern"), own.alias("own"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("row")), "sizes")
    rows = sizes.groupBy("pattern").agg(F.first("own").alias("own"), F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: r["pattern"])
    names = sorted({s for r in rows for s in r["own"]}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    at = {s: k for k, s in enumerate(names)}
    totals = [0] * len(names)
    for r in rows:
        for s in r["own"]:
            totals[at[s]] += r["size"]
    targets = shared_targets(totals, [weights[k % len(weights)] for k in range(len(names))], share * sum(r["size"] for r in rows) / max(1, sum(totals)), repeats)
    flow = min_cost_flow([r["size"] for r in rows], [[at[s] for s in r["own"]] for r in rows], [round(t) for t in targets], repeats)
    table = [(r["pattern"], r["size"], sum(f.values()), totals[at[r["own"][0]]], float(targets[at[r["own"][0]]])) for r, f in zip(rows, flow, strict=True)]
    quotas = spark.createDataFrame(table, "pattern string, total long, quota long, source_size long, target double")
    chosen = select_seeded(sizes.drop("own"), quotas, seed, id_col)
    facts = quotas.select(F.col("pattern").alias("p"), "source_size", "target")
    return chosen.join(facts, F.col("pattern") == F.col("p")).select(id_col, "size", "source_size", "target", "taken", "row", "pattern")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 8, text: str = "text", id_col: str = "doc_id", source: str | Column = "source") -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it is taken, a last use in part with its first words.

    All columns pass through. A row is known by id (null is one), text hash,
    sources and its number among the rows alike in these, so each row meets
    the words taken for it.
    """
    taken = _mixed(docs, weights, share, repeats, seed, text, id_col, source)
    nth = F.row_number().over(Window.partitionBy(id_col, "row", "pattern").orderBy(F.desc("taken")))
    taken = taken.withColumn("nth", nth).filter("taken > 0").select(F.col(id_col).alias("t_id"), F.col("row").alias("t_row"), F.col("pattern").alias("t_pattern"), F.col("nth").alias("t_nth"), "size", "taken")
    known = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"), _memberships(source)[1].alias("pattern"))
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("id", "row", "pattern").orderBy(F.lit(0))))
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("row") == F.col("t_row")) & (F.col("pattern") == F.col("t_pattern"))
    joined = known.join(taken, same & (F.col("nth") == F.col("t_nth")))
    full, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    uses = joined.withColumn("part", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    # pieces of a word with the blanks before it
    head = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("part").cast("int")), "")
    told = F.when(F.col("part") > 0, head).otherwise(F.col("text"))
    return uses.select(*[(told if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
