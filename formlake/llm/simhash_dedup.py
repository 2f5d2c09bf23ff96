"""SimHash near-duplicate detection by bit-sliced comparison.

Documents get a 64-bit SimHash of their word shingles. Equal fingerprints
collapse first (a group-by with map-side combine, so thousands of copies cost
one row), then distinct fingerprints meet in pigeonhole buckets: two that
differ in at most ``radius`` bits agree on at least ``m`` of ``radius + m``
bit blocks, so one bucket per choice of ``m`` blocks finds every pair. ``m``
follows from the number of fingerprints, to keep random buckets small; the
result is exact for each ``m``.

Inside a bucket the fingerprints are stored as 64 vertical bit planes. A query
fingerprint is compared with 64 others per machine word: the XOR of each plane
is added to a carry-save bitwise counter, and words whose lanes all exceed the
radius are abandoned. Only a spanning forest of each bucket's links leaves the
task, so a bucket of n near copies emits at most n - 1 rows. Buckets above
``MAX_BUCKET`` are dealt out as pairs of salted parts: no link is lost and no
task holds more than two parts.

``keep_one_per_group`` wants word-shingle similarity instead of near bits. No
choice of a few of 64 bits meets so wide a radius and still tells texts apart in
a large corpus, so its buckets come from the shingles: each falls into a block
by its hash, and texts meet where a block holds the same shingles. The bit-sliced
comparison then passes over all but near ones, whose shingle sets are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.llm.components import connected_components
from formlake.llm.work import materialise

RADIUS = 15  # of the candidates of keep_one_per_group
SIMILARITY = 0.8
IN_BLOCK = 4  # shingles of a block, at least; twice as many at most
KEPT_BLOCKS = 24
SHORT = 20  # shingles of a text that also meets on single ones
MAX_BUCKET = 8192
RANDOM_BUCKET = 512
_ITEMS = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(parts: list[bytes], words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` of the words ``parts``, in order; fewer words are one run."""
    import xxhash

    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)
    return int(bits[0])


def block_keys(distinct: np.ndarray, similarity: float) -> np.ndarray:
    """Bucket keys (int64) of a text with these distinct shingle hashes.

    A text of n shingles has 2^k blocks of IN_BLOCK to 2 IN_BLOCK shingles on
    average, and keys for KEPT_BLOCKS of them; also for the k of n / similarity
    shingles, so that texts of different sizes meet. Of similar texts with a
    Jaccard similarity J a block of c shingles is the same with a chance of
    about J^c or more. Texts of SHORT shingles or fewer have too few blocks for
    that; in addition each of their first shingles is a key, in the order of the
    hashes and so many that two texts of this similarity share one for certain.
    """
    if not len(distinct):
        return np.zeros(0, np.int64)
    keys = []
    if len(distinct) <= SHORT:
        first = len(distinct) - int(np.ceil(similarity * len(distinct) - 1e-9)) + 1
        keys.append((np.sort(distinct)[:first] ^ np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    mixed = distinct * np.uint64(0x9E3779B97F4A7C15)
    for k in sorted({max(0, int(n / IN_BLOCK).bit_length() - 1) for n in (len(distinct), len(distinct) / similarity)}):
        block = (mixed >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(mixed), np.int64)
        kept = block < KEPT_BLOCKS
        total = np.zeros(min(1 << k, KEPT_BLOCKS), np.uint64)
        np.add.at(total, block[kept], distinct[kept])
        some = np.flatnonzero(total)
        keys.append((total[some] ^ (some.astype(np.uint64) + np.uint64(1 + 64 * k)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return np.concatenate(keys)


def simhash(data: bytes, words: int) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer."""
    parts = data.lower().split()
    return _majority(_shingles(parts, words)) if parts else 0


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4) -> DataFrame:
    """(id, fingerprint long): ASCII letters lower-cased, shingles of ``words`` words.

    Fewer words: the whole sequence is the one shingle. Null or blank text: 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(x, words) if x else 0 for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fingerprint long")


def _planes(fp: np.ndarray, word: np.ndarray, lane: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [64, words] and the mask of filled lanes [words]."""
    bits = np.zeros((n_words * 64, 64), np.uint8)
    at = word * 64 + lane
    bits[at] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    filled = np.zeros(n_words * 64, np.uint8)
    filled[at] = 1
    pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view(np.uint64)[..., 0]
    return pack(np.ascontiguousarray(bits.reshape(n_words, 64, 64).transpose(2, 0, 1))), pack(filled.reshape(n_words, 64))


def _within(planes: np.ndarray, fp: np.ndarray, q: np.ndarray, w: np.ndarray, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items (query q, word w): the lanes within the radius; only items that have any.

    The counter starts at 2^k - 1 - radius, so that its overflow marks a lane
    as beyond the radius.
    """
    k = max(1, int(radius).bit_length())
    first = (1 << k) - 1 - radius
    count = [np.full(len(q), _ONES if first >> i & 1 else 0, np.uint64) for i in range(k)]
    bits = fp[q]
    for b in range(0, 64, 2):
        x, y = (planes[c][w] ^ (np.uint64(0) - ((bits >> np.uint64(c)) & np.uint64(1))) for c in (b, b + 1))
        half = x ^ y
        carry = (x & y) | (half & count[0])  # a full adder of two planes and the lowest counter bit
        count[0] = count[0] ^ half
        for i in range(1, k):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over = over | carry
        if b % 8 == 6:
            alive = over != _ONES
            if not alive.all():
                if not alive.any():
                    return q[:0], w[:0], over[:0]
                q, w, bits, over = q[alive], w[alive], bits[alive], over[alive]
                count = [c[alive] for c in count]
    return q, w, ~over


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a and b; label[i] is the smallest member of i's set."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _hits(fp: np.ndarray, group: np.ndarray, radius: int, settled: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices within ``radius`` inside each group, the first the smaller one.

    Words whose elements all have the query's value of ``settled()`` may be passed over.
    """
    n = len(fp)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [n])))
    of = np.repeat(np.arange(len(start)), size)
    words = (size + 63) // 64
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    rank = np.arange(n) - start[of]
    word, lane = first[of] + rank // 64, rank % 64
    planes, filled = _planes(fp, word, lane, int(words.sum()))
    element = np.full(int(words.sum()) * 64, -1, np.int64)
    element[word * 64 + lane] = np.arange(n)
    last = (first + words)[of]
    after = np.where(lane == 63, np.uint64(0), _ONES << (lane + 1).astype(np.uint64) % np.uint64(64))
    span = last - word
    done = 0
    ends = np.cumsum(span)
    while done < n:  # so many queries at once that their items stay within _ITEMS, one query at least
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _ITEMS, "right")))
        reps = span[done:stop]
        q = np.repeat(np.arange(done, stop), reps)
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        valid = np.where(w == word[q], filled[w] & after[q], filled[w])
        if int(size.max()) > 64 and done:  # words whose lanes all belong to the query's set already have nothing to add
            label = settled()
            lab = np.where(element >= 0, label[element], np.iinfo(np.int64).max).reshape(-1, 64)
            low, high = lab.min(axis=1), np.where(element.reshape(-1, 64) >= 0, lab, -1).max(axis=1)
            valid = np.where((low[w] == high[w]) & (low[w] == label[q]), np.uint64(0), valid)
        some = valid != 0
        q, w, hit = _within(planes, fp, q[some], w[some], ~valid[some], radius)
        for at in range(0, len(q), 4096):
            lanes = np.unpackbits(hit[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(lanes)
            yield q[at : at + 4096][i], element[w[at : at + 4096][i] * 64 + j]
        done = stop


def bucket_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each group: indices (member, root).

    ``fp``: uint64, ``group``: any values, equal ones adjacent.
    """
    label = np.arange(len(fp))
    if len(fp) < 2:
        return label[:0], label[:0]
    for a, b in _hits(fp, group, radius, lambda: label):
        label = _merge(label, a, b)
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


def _blocks(fp: Column, radius: int, m: int) -> Column:
    """Array of bucket keys: one for each choice of m of the radius + m bit blocks."""
    n = radius + m
    cut = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(fp, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)) for i in range(n)]
    keys = []
    for band, chosen in enumerate(combinations(range(n), m)):
        key = F.lit(band).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cut[i + 1] - cut[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def _choose_m(n: int, radius: int) -> int:
    """Smallest m whose random buckets hold RANDOM_BUCKET fingerprints at most."""
    for m in range(1, 5):
        if n >> (64 * m // (radius + m)) <= RANDOM_BUCKET:
            return m
    return 4


def _dealt(bands: DataFrame, key: str) -> DataFrame:
    """``bands`` with the part numbers (i, j) first, shuffled; buckets above MAX_BUCKET as pairs of parts by hash of ``key``."""
    large = bands.groupBy("bucket").count().filter(F.col("count") > MAX_BUCKET)
    large = large.select("bucket", F.ceil(F.col("count") / MAX_BUCKET).cast("int").alias("parts"))
    others = [c for c in bands.columns if c != "bucket"]
    bands = bands.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    bands = bands.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = bands.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *others)
    return dealt.repartition("bucket", "i", "j")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows as int64 matrices that end where a bucket (the first three columns) does."""
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
        n += b.num_rows
        if n >= MAX_BUCKET:
            rows = np.concatenate(held)
            whole = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield rows[:cut]
            held, n = [rows[cut:]], len(rows) - cut
    if n:
        yield np.concatenate(held)


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps.fingerprint`` within ``radius``.

    ``fps``: distinct non-null fingerprints. ``radius``: 0 to 15.
    """
    m = _choose_m(fps.count(), radius)
    bands = fps.select("fingerprint", F.explode(_blocks(F.col("fingerprint"), radius, m)).alias("bucket"))
    dealt = _dealt(bands, "fingerprint").sortWithinPartitions("bucket", "i", "j", "fingerprint")

    def links(rows: np.ndarray) -> pa.RecordBatch:
        step = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        fp = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        child, root = bucket_links(fp, np.concatenate(([0], np.cumsum(step))), radius)
        return pa.RecordBatch.from_arrays([pa.array(rows[child, 3]), pa.array(rows[root, 3])], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: map(links, _whole_buckets(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: (id_col, fingerprint long, component_id).

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits. Rows with a null id are fingerprinted too and
    carry the smallest non-null id of their group (null if it has none); a
    repeated row comes back as often as it came in; null and blank texts share
    the fingerprint 0; an empty table gives an empty result; further columns
    are ignored.
    """
    rows = materialise(fingerprints(docs, text, id_col, words), "fingerprints")
    distinct = materialise(rows.groupBy("fingerprint").agg(F.min("id").alias("low")), "distinct")
    parts = connected_components(fingerprint_links(distinct.select("fingerprint"), radius))
    found = distinct.join(parts, distinct["fingerprint"] == parts["node"], "left")
    found = materialise(found.select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")), "roots")
    lowest = found.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialise(found.join(lowest, "root").select(F.col("fingerprint").alias("fp"), "component_id"), "classes")
    out = rows.join(classes, rows["fingerprint"] == classes["fp"])
    return out.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def _candidates(nodes: DataFrame, radius: int, similarity: float, every: int) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes`` (node, fingerprint, n, g, keys) that share a key and are within ``radius``, as far as their numbers ``n`` of shingles allow ``similarity``.

    ``every`` = 1: all pairs whose ``g`` differ. Above 1, a first look, for
    groups of many near copies: of each ``every``-th key, each node's next
    neighbour in a bucket and the neighbours of the node that has most.
    """
    keys = F.filter("keys", lambda _, k: k % every == 0) if every > 1 else F.col("keys")
    bands = nodes.select("g", "fingerprint", "node", "n", F.explode(keys).alias("bucket"))
    dealt = _dealt(bands, "node").sortWithinPartitions("bucket", "i", "j", "g", "fingerprint", "node")

    def near_size(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(n[a], n[b]) >= (similarity - 1e-9) * np.maximum(n[a], n[b])

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.concatenate(([0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        g, node, n = np.unique(rows[:, 3], return_inverse=True)[1], rows[:, 5], rows[:, 6]
        fp = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])
        if every == 1:
            for a, b in _hits(fp, group, radius, lambda: g):
                some = (g[a] != g[b]) & near_size(n, a, b)
                if some.any():
                    yield batch(a[some], b[some])
            return
        degree, linked = np.zeros(len(fp), np.int64), np.full(len(fp), len(fp))
        for a, b in _hits(fp, group, radius, lambda: np.arange(len(fp))):
            some = near_size(n, a, b)
            a, b = a[some], b[some]
            degree += np.bincount(a, minlength=len(fp)) + np.bincount(b, minlength=len(fp))
            np.minimum.at(linked, a, b)
        a = np.flatnonzero(linked < len(fp))
        if len(a):
            yield batch(a, linked[a])
        order = np.lexsort((degree, group))
        hub = order[np.concatenate((np.flatnonzero(np.diff(group)), [len(group) - 1]))][group]
        a = np.arange(len(fp))
        a = a[(a != hub) & (np.bitwise_count(fp ^ fp[hub]) <= radius) & near_size(n, a, hub)]
        if len(a):
            yield batch(a, hub[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            if len(rows) > 1:
                yield from pairs(rows)

    return materialise(dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct(), "candidates")


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` of nodes whose sets of shingles have the Jaccard ``similarity``.

    ``nodes``: with ``place``, where a text of the node stands in ``docs`` (id, row, text).
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    wanted = nodes.join(wanted, F.col("node") == F.col("w")).select("node", F.col("place.id").alias("_id"), F.col("place.row").alias("_row"))
    found = docs.join(wanted, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [x.lower().split() if x else [] for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(_shingles(p, words)).tobytes() if p else b"" for p in own], pa.binary())], names=["node", "set"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= (similarity - 1e-9) * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = materialise(found.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]), "shingle-sets")
    met = pairs.join(own.select(F.col("node").alias("na"), F.col("set").alias("x")), F.col("a") == F.col("na"))
    met = met.join(own.select(F.col("node").alias("nb"), F.col("set").alias("y")), F.col("b") == F.col("nb"))
    return materialise(met.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "similar")


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: (id, row, group), ``row`` the xxhash64 of the text.

    Texts of the same words (ASCII letters lower-cased) are one node, by 64
    bits of hash; null and blank texts are one too. Nodes are linked if their
    SimHashes differ in at most ``radius`` bits, a block of their shingles is the
    same (``block_keys``), and their sets of shingles of ``words`` words have a
    Jaccard similarity of ``similarity`` or more.
    ``group`` names the connected group.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = []
            for x in b.column(2).cast(pa.binary()).to_pylist():
                parts = x.lower().split() if x else []
                h = _shingles(parts, words) if parts else np.zeros(0, np.uint64)
                node = np.uint64(xxhash.xxh64_intdigest(b" ".join(parts), 7)).view(np.int64)
                distinct = np.unique(h)
                out.append((int(node), _majority(h) if parts else 0, len(distinct), block_keys(distinct, similarity)))
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            columns = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "row", "node", "fingerprint", "n", "keys"])

    rows = materialise(base.select("id", "row", "text").mapInArrow(run, f"id {kind}, row long, node long, fingerprint long, n long, keys array<long>"), "shingled")
    nodes = rows.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("n").alias("n"), F.min(F.struct("id", "row")).alias("place"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    links = _similar(_candidates(nodes.withColumn("g", F.col("node")), radius, similarity, 4), nodes, base, words, similarity)
    known = connected_components(links).withColumnRenamed("node", "k")
    grouped = nodes.join(known, F.col("node") == F.col("k"), "left").withColumn("g", F.coalesce("root", "node"))
    links = links.unionByName(_similar(_candidates(grouped, radius, similarity, 1), nodes, base, words, similarity))
    parts = connected_components(links).withColumnRenamed("node", "k")
    return rows.join(parts, F.col("node") == F.col("k"), "left").select(F.col("id").alias(id_col), "row", F.coalesce("root", "node").alias("group"))


def keep_one_per_group(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 5, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``similar_groups``, all columns: that with the smallest (id, text hash).

    Rows that share an id but not a group stay each. A row without an id cannot
    be named as the copy of another and stays.
    """
    groups = similar_groups(docs, text, id_col, words, radius, similarity).filter(F.col(id_col).isNotNull())
    keep = groups.groupBy("group").agg(F.min(F.struct(id_col, "row")).alias("k")).select(F.col(f"k.{id_col}").alias("__keep__"), F.col("k.row").alias("__keep_row__"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("row"))
    kept = rows.join(keep, (F.col("id") == F.col("__keep__")) & (F.col("row") == F.col("__keep_row__")), "left_semi").dropDuplicates(["id", "row"])
    return kept.select("doc.*").unionByName(docs.filter(F.col(id_col).isNull()))
