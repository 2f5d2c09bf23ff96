import collections
import math
import random
import re

import numpy as np
import pytest
from conftest_llm import DOCS, document, prose  # noqa: F401
from pyspark.sql import functions as F

from formlake.llm import components, line_dedup, simhash_dedup


def closure(near):
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        if (low == label).all():
            return label
        label = low


@pytest.mark.parametrize("groups", [1, 9])
def test_bit_sliced_links_equal_brute_force(groups):
    rng = np.random.default_rng(groups)
    base = rng.integers(0, 2**64, size=12, dtype=np.uint64)
    fp = base[rng.integers(0, 12, 700)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    fp = np.unique(fp)
    group = np.sort(rng.integers(0, groups, len(fp)))
    for radius in (0, 1, 4, 7):
        member, root = simhash_dedup.bucket_links(fp, group, radius)
        label = np.arange(len(fp))
        label[member] = root
        near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & (group[:, None] == group[None, :])
        assert (label == closure(near)).all()


def test_large_buckets_are_dealt_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fp = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fp = np.unique(fp).view(np.int64)
    monkeypatch.setattr(simhash_dedup, "MAX_BUCKET", 40)
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(int(x),) for x in fp], "fingerprint long"), 4)
    parts = components.connected_components(links).collect()
    assert len(parts) == len(fp) and len({r["root"] for r in parts}) == 1


def test_components_of_chains_loops_and_nothing(spark):
    rows = [(k, k + 1) for k in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100), (100, 101)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    rows = simhash_dedup.near_duplicates(odd).collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    assert len(rows) == 11 and len(found[2]) == 2
    assert found[1][0]["component_id"] == found[7][0]["component_id"] == 1
    assert {found[k][0]["fingerprint"] for k in (3, 4, 6)} == {0} and {found[k][0]["component_id"] for k in (3, 4, 6)} == {3}
    assert {r["component_id"] for r in found[None]} == {None, 3}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "8", "9", "None", "None"])


def test_simhash_by_definition():
    import xxhash

    text = "One  two\tTHREE four five six four five"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash_dedup.simhash(text.encode(), 4) % 2**64 == want
    assert simhash_dedup.simhash(b"a B", 4) % 2**64 == xxhash.xxh64_intdigest(b"a b", 42)


def test_lines_on_odd_rows(spark, odd, empty):
    rows = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(odd).collect()}
    assert line_dedup.dedup_lines(odd).count() == 11
    assert rows[(1, prose(1))]["n_dropped"] == 0 and rows[(7, "")]["n_dropped"] == 1
    assert rows[(4, None)]["n_lines"] == 0 and rows[(3, "")]["n_lines"] == 1 and rows[(6, " \n\t ")]["n_lines"] == 2
    assert line_dedup.dedup_lines(empty).count() == 0
    assert set(line_dedup.dedup_lines(odd).columns) == set(odd.columns) | {"n_dropped"}


def test_like_lines_form_groups(spark):
    line = prose(9, 120)
    almost = line.replace(line.split()[50], "zulu")
    docs = spark.createDataFrame([document(1, line + "\nshort one"), document(2, almost + "\nshort one"), document(3, line.upper() + "!"), document(4, prose(10, 120))], DOCS)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == {1: line + "\nshort one", 2: "", 3: "", 4: prose(10, 120)}


def test_equal_lines_of_all_kinds(spark):
    lines = ["Read more", "* * *", "\u0130" * 20_000, "漢字の行", "ok", "क़िला हिन्दी"]
    texts = {1: "\n".join(lines), 2: "\n\n".join(lines) + "\n ", 3: "*  *\u00a0*\nक़ला हिन्दी"}
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([document(k, t) for k, t in texts.items()], DOCS)).collect()}
    assert rows[1]["n_dropped"] == 0 and rows[2]["text"] == "\n\n\n\n\n " and rows[2]["n_dropped"] == 6
    assert rows[3]["text"] == "क़ला हिन्दी"


def distance(a, b):
    row = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def block_keys(line):
    """The buckets of a line by the definition: blocks of its SimHash, or pairs of them."""
    import itertools
    import math

    import xxhash

    words = set(line.split(" "))

    def class_of(n):
        small = [k for k, c in enumerate(line_dedup.CLASSES) if n < c[0]]
        return small[0] if small else len(line_dedup.CLASSES) + int(math.log2(n / line_dedup.CLASSES[-1][0]))

    keys = set()
    for cls in {class_of(len(words)), class_of(int(len(words) * line_dedup.SLACK))}:
        last = len(line_dedup.CLASSES) - 1
        n, m = line_dedup.CLASSES[cls][1:] if cls <= last else (line_dedup.CLASSES[last][1] << (cls - last), 1)
        blocks = {}
        for w in words:
            h = xxhash.xxh64_intdigest(w, 42)
            blocks.setdefault((h >> 4 & 0x0F0F0F0F0F0F0F0F) % n, []).append((h, len(w)))
        blocks = {j: v for j, v in blocks.items() if j < line_dedup.KEPT}
        bits = {j: tuple(2 * sum(h >> k + 8 * f & 1 for h, _ in v) > len(v) for k in range(4) for f in range(7)) + (len(v), sum(c for _, c in v)) for j, v in blocks.items()}
        for own in itertools.combinations(range(min(n, line_dedup.KEPT)), m):
            if sum(bits[j][-1] for j in own if j in bits) >= line_dedup.LEAST_CHARS:
                keys.add((cls, own, tuple(bits.get(j) for j in own)))
    return keys


def test_line_groups_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    lines = []
    for k in range(70):
        words = prose(900 + k, rng.choice((6, 9, 14, 30, 45, 70, 130, 260))).split()
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(len(words)), rng.randrange(0, 1 + len(words) // 12)):
                other[at] = rng.choice(["zulu%d" % rng.randrange(99), other[at][::-1]])
            if rng.random() < 0.4:
                other.insert(rng.randrange(len(other)), "extra%d" % rng.randrange(99))
            lines.append(" ".join(other))
    lines = sorted(set(lines))
    similar = lambda a, b: distance(a, b) <= int((0.2 + 1e-9) * max(len(a), len(b)))
    keys = [block_keys(x) for x in lines]
    near = np.eye(len(lines), dtype=bool)
    alike = []
    for i in range(len(lines)):
        for j in range(i):
            if min(len(lines[i]), len(lines[j])) >= 0.8 * max(len(lines[i]), len(lines[j])) and set(lines[i].split()) & set(lines[j].split()) and similar(lines[i], lines[j]):
                alike.append((i, j))
                near[i, j] = near[j, i] = bool(keys[i] & keys[j])
    group = closure(near)
    assert sum(group[i] == group[j] for i, j in alike) >= 0.9 * len(alike) > 60
    docs = spark.createDataFrame([document(k, x) for k, x in enumerate(lines)], DOCS).repartition(4)
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect() if r["text"]}
    assert kept == set(group.tolist())


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_short_lines_meet_exactly(spark, similarity):
    """Lines of 1 to 40 characters with letters changed, dropped and put in: all pairs of the similarity are joined, others are not."""
    rng = random.Random(4)
    lines = {"abc def ghi", "abc def ghj", "kurzer satz hier", "kurzer satz hiers", "漢字試験問題集", "漢字試験問題票", "a", "b", "ab"}
    for _ in range(90):
        one = "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(3, 40)))
        lines.add(" ".join(one.split()) or "x")
        for _ in range(3):
            other = list(one)
            for _ in range(rng.randrange(1, 2 + len(one) // 5)):
                at = rng.randrange(len(other))
                other[at] = rng.choice(["", other[at] + "k", rng.choice("lmn")])
            lines.add(" ".join("".join(other).split()) or "x")
    lines = sorted(lines)
    spaced = [" ".join(x) if len(x.encode()) > 2 * len(x) else x for x in lines]
    near = np.eye(len(lines), dtype=bool)
    for i, x in enumerate(spaced):
        for j, y in enumerate(spaced[:i]):
            if min(len(x), len(y)) <= 32 and abs(len(x) - len(y)) <= 8:
                near[i, j] = near[j, i] = distance(x, y) <= int((1 - similarity + 1e-9) * max(len(x), len(y)))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(docs, similarity=similarity).collect() if r["text"]}
    want = set(closure(near).tolist())
    assert len(lines) - len(want) > 60
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h1 long, norm string")
    keys = {}
    for r in line_dedup.short_buckets(rows, similarity).collect():
        keys.setdefault(r["h1"], set()).add(r["bucket"])
    assert all(keys[i] & keys[j] for i, j in np.argwhere(near) if i != j)
    assert kept <= want and all(len(lines[k]) > 26 for k in want - kept)  # these also meet longer lines, by blocks


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    words = prose(3, 200).split()
    texts = [" ".join(words[:k] + ["zulu"] + words[k + 1 :]) for k in range(0, 60, 3)] + [" ".join(words[60:] + prose(k, 60).split()) for k in range(20)]
    docs = spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], DOCS)
    usual = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [k for k, t in usual.items() if t and k < 20] == [0]
    monkeypatch.setattr(line_dedup, "HOT", 2)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == usual


def test_short_lines_that_only_share_segments_are_no_pairs(spark, monkeypatch):
    """Short lines of frequent words meet by the hundred; of those pairs only the ones alike leave the buckets."""
    rng = random.Random(2)
    words = ["the", "and", "tion", "ing", "ere", "ou", "st", "nd"]
    lines = sorted({" ".join(rng.choice(words) for _ in range(9))[:30].strip() for _ in range(160)} | {"漢字試験問題集", "漢字試験問題票", "漢字試験問回集"})
    seen = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts, similarity: seen.append((pairs.count(), out := verified(pairs, texts, similarity))) or out)
    rows = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string").repartition(4)
    links = [tuple(r) for r in line_dedup.line_links(rows, 0.9).collect()]
    spaced = [" ".join(x) if len(x.encode()) > 2 * len(x) else x for x in lines]
    near = np.eye(len(lines), dtype=bool)
    joined = near.copy()
    for a, b in links:
        joined[a, b] = joined[b, a] = True
    for i, x in enumerate(spaced):
        for j, y in enumerate(spaced[:i]):
            near[i, j] = near[j, i] = abs(len(x) - len(y)) <= 4 and distance(x, y) <= int((0.1 + 1e-9) * max(len(x), len(y)))
    assert closure(joined).tolist() == closure(near).tolist() and near.sum() > len(lines)
    (_, _), (pairs, found) = seen
    assert pairs == found.count() > 0


def test_lines_around_one_passage_cost_few_pairs(spark, monkeypatch):
    """Lines that share a long passage meet in one bucket; those alike are joined in rounds, and the pairs that are not alike stay inside it."""
    rng = random.Random(6)
    passage = prose(5, 40)
    texts = [" ".join(filter(None, (prose(100 + k, rng.randrange(16)), passage, prose(400 + k, rng.randrange(16))))) for k in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "h1 long, norm string").repartition(4)
    verified, seen = line_dedup._verified, []
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts, similarity: seen.append(pairs.count()) or verified(pairs, texts, similarity))

    def groups():
        seen.clear()
        joined = np.eye(len(texts), dtype=bool)
        for a, b in line_dedup.line_links(rows).collect():
            joined[a, b] = joined[b, a] = True
        return closure(joined).tolist()

    monkeypatch.setattr(line_dedup, "CROWD", 8, raising=False)
    found, pairs = groups(), list(seen)
    monkeypatch.setattr(line_dedup, "ROUNDS", 0, raising=False)
    monkeypatch.setattr(line_dedup, "CROWD", 1 << 30, raising=False)
    assert groups() == found and 1 < len(set(found)) < len(texts)  # as without rounds, where every pair leaves the bucket
    assert 8 * pairs[-1] <= seen[-1] > 4 * len(texts) and sum(pairs[:-1]) <= 5 * len(texts), (pairs, seen)


def test_edit_similarity_by_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = []
    for k in range(400):
        a = prose(k, rng.randrange(1, 40)).split() if k % 2 else [rng.choice(["ab", "abc", "b", "xyz"]) for _ in range(rng.randrange(1, 12))]
        b = [w if rng.random() < 0.9 else w[:-1] + "x" for w in a if rng.random() < 0.95] or ["b"]
        if rng.random() < 0.7:
            b.insert(rng.randrange(len(b) + 1), rng.choice(["ab", "zz"]))
        rows.append((" ".join(a), " ".join(b), 7))
    df = spark.createDataFrame(rows, "x string, y string, n int")
    got = line_dedup.edit_similar(df.select("x", "y"), "x", "y", 0.8).collect()
    got = {(r["x"], r["y"]) for r in got}
    want = {(a, b) for a, b, _ in rows if distance(a, b) <= int((0.2 + 1e-9) * max(len(a), len(b)))}
    assert got <= want and len(got) >= 0.95 * len(want) > 150


def test_one_measure_for_all_lengths(spark):
    def pair(n, every):
        words = prose(n, n).split()
        return " ".join(words), " ".join(w[:-1] + "q" if k % every == 0 else w for k, w in enumerate(words))

    rows = [(n, every, *pair(n, every)) for n in (30, 300, 3000) for every in (1, 2)]
    got = line_dedup.edit_similar(spark.createDataFrame(rows, "n int, every int, x string, y string"), "x", "y", 0.9).collect()
    assert sorted((r["n"], r["every"]) for r in got) == [(30, 2), (300, 2), (3000, 2)]


def test_stage_joins_pairs_of_similarity_four_fifths(spark):
    import random

    rng = random.Random(1)
    texts = {}
    for k in range(120):
        words = prose(500 + k, rng.choice((60, 150, 400))).split()
        texts[2 * k] = " ".join(words)
        for at in rng.sample(range(0, len(words), 6), rng.randrange(1, max(2, len(words) // 36))):
            words[at] = "zulu"
        texts[2 * k + 1] = " ".join(words)
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    alike = [(a, b) for a in texts for b in texts if a < b and jaccard(a, b) >= 0.8]
    docs = spark.createDataFrame([document(k, t) for k, t in texts.items()], DOCS)
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.similar_groups(docs).collect()}
    found = [(a, b) for a, b in alike if group[a] == group[b]]
    assert min(jaccard(a, b) for a, b in alike) < 0.85 and len(found) >= 0.95 * len(alike) > 30
    assert {(a, b) for a in texts for b in texts if a < b and group[a] == group[b]} <= set(alike)
    kept = {r["doc_id"] for r in simhash_dedup.keep_one_per_group(docs).collect()}
    assert kept == set(texts) - {b for _, b in found}


def test_stage_finds_all_candidates_in_dealt_buckets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, size=3, dtype=np.uint64)
    fp = base[rng.integers(0, 3, 240)]
    for _ in range(9):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64))
    rows = [(int(x), k, int(rng.integers(90, 130)), k % 7, [int(v) for v in {*rng.integers(0, 6, 5)}]) for k, x in enumerate(fp.view(np.int64))]
    nodes = spark.createDataFrame(rows, "fingerprint long, node long, n long, g long, keys array<long>")
    near = lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 15 and min(rows[a][2], rows[b][2]) >= 0.8 * max(rows[a][2], rows[b][2]) and set(rows[a][4]) & set(rows[b][4])
    want = {(a, b) for a in range(240) for b in range(a + 1, 240) if near(a, b)}
    monkeypatch.setattr(simhash_dedup, "MAX_BUCKET", 40)
    assert {tuple(r) for r in simhash_dedup._candidates(nodes, 15, 0.8, 1).collect()} == {(a, b) for a, b in want if a % 7 != b % 7}
    assert {tuple(r) for r in simhash_dedup._candidates(nodes, 15, 0.8, 4).collect()} <= want


def test_blocks_of_similar_texts_agree():
    rng = np.random.default_rng(3)
    found = []
    for k in range(600):
        n = int(rng.integers(12, 3000))
        own = rng.integers(0, 2**64, size=n, dtype=np.uint64)
        drop = round(n * 0.2 / 1.8)
        other = np.concatenate((own[drop:], rng.integers(0, 2**64, size=drop, dtype=np.uint64))) if k % 2 else own[round(n * 0.2) :]
        keys = [set(simhash_dedup.block_keys(np.unique(x), 0.8).tolist()) for x in (own, other)]
        found.append(bool(keys[0] & keys[1]))
    assert np.mean(found) >= 0.95
    assert len(simhash_dedup.block_keys(np.zeros(0, np.uint64), 0.8)) == 0


def test_stage_joins_short_texts(spark):
    """Pairs of 7 to 30 words with the last word changed or one added, similarity of 0.8 and more: nine in ten meet, whatever the length."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(9000)]
    pairs = []
    for n in range(7, 31):
        for k in range(24):
            one = [rng.choice(words) for _ in range(n)]
            other = [*one, rng.choice(words)] if k % 2 else [*one[:-1], rng.choice(words)]
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, other))
            if len(a & b) / len(a | b) >= 0.8:
                pairs.append((n, " ".join(one), " ".join(other)))
    rows = [(2 * k + j, p[1 + j]) for k, p in enumerate(pairs) for j in (0, 1)]
    group = {r["doc_id"]: r["group"] for r in simhash_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((7, 10), (10, 13), (13, 17), (17, 31)):
        met = [group[2 * k] == group[2 * k + 1] for k, p in enumerate(pairs) if low <= p[0] < high]
        assert len(met) >= 20 and sum(met) >= 0.9 * len(met), (low, sum(met), len(met))
    assert len(set(group.values())) >= len(pairs)


def test_edit_similar_leaves_out_no_pair(spark):
    """Text moved, many words put in, letters changed all over, at 60 to 1,600 characters: the whole distance decides, also where letters get blanks."""
    rng = random.Random(8)
    rows = [("क़िलापरकमलखड़ाहै", "क़िलापरकमलदखड़ाहैव"), ("漢字漢字漢字ab ab ab", "漢字漢字漢字ab abc ab")]
    for size in (14, 60, 110, 240):
        for _ in range(6):
            words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(size)]
            text, share = " ".join(words), rng.choice((0.1, 0.17, 0.21))
            at, n = rng.randrange(size // 2), max(1, int(size * share / 2))
            rows.append((text, " ".join(words[:at] + words[at + n : size - n] + words[at : at + n] + words[size - n :])))
            rows.append((text, " ".join(words[:at] + ["xy"] * int(size * share * 1.8) + words[at:])))
            rows.append((text, "".join(c if rng.random() > share else rng.choice(["", c + "z", "y "]) for c in text)))
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], "n int, x string, y string")
    spread = lambda x: re.sub(r"([^\W\d_][ऀ-ःऺ-ॏ]*) ?", r"\1 ", x).strip() if len(x.encode()) > 2 * len(x) else x
    near = lambda x, y: distance(x, y) <= int((0.2 + 1e-9) * max(len(x), len(y)))
    want = {k for k, (x, y) in enumerate(rows) if near(x, y) or near(spread(x), spread(y))}
    assert {r["n"] for r in line_dedup.edit_similar(df, "x", "y", 0.8).collect()} == want
    assert {0, 1} <= want and 10 < len(want) < len(rows) - 10


def test_buckets_of_short_lines_reckon_each_text_once(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(1, "a line of few words"), (2, "a line of fewer words")], "h1 long, norm string")
    found = line_dedup.short_buckets(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.count("split(") == 1, (plan.count("regexp_replace("), plan.count("split("))
    assert {r["h1"] for r in found.groupBy("bucket").agg(F.collect_set("h1").alias("h")).filter("size(h) = 2").select(F.explode("h").alias("h1")).collect()} == {1, 2}


def test_long_texts_without_their_common_ends(spark):
    """Bounds that are tried first, and ends that are cut off, leave the decision of the whole edit distance as it is."""
    draw = random.Random(9)
    letters = "ab \u00e9\U0001f600"
    base = "".join(draw.choices(letters, k=line_dedup.LONG + 60))
    pairs = [(base, base), (base, base[:-1]), ("", ""), ("", "a"), ("\u00e9x", "\u00e9y"), ("aaa", "aa"), ("abab", "ab")]
    for edits in (3, 60, 120, 240, 480):
        y = list(base)
        for at in sorted(draw.sample(range(700, 1500), edits), reverse=True):
            draw.choice([lambda: y.pop(at), lambda: y.insert(at, "q"), lambda: y.__setitem__(at, "z")])()
        pairs.append((base, "".join(y)))
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x string, y string")
    d = F.levenshtein("x", "y")
    near = [line_dedup._within_most(F.col("x"), F.col("y"), d + n).alias(f"w{i}") for i, n in enumerate((-1, 0, 1, 500))]
    got = rows.select("k", line_dedup._common_length("x", "y").alias("n"), d.alias("d"), *near).collect()
    for k, n, dist, *w in got:
        x, y = pairs[k]
        assert n == next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert w[1:] == [True] * 3 and (w[0] is False or dist == 0)
    like = {r["k"] for r in line_dedup.edit_similar(rows.filter("k < 2 or k > 6"), "x", "y", 0.9).collect()}
    assert like == {k for k, _, dist, *_ in got if (k < 2 or k > 6) and dist <= math.floor(0.1 * max(map(len, pairs[k])) + 1e-6)}
