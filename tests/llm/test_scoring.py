import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import DOCS, document, prose
from formlake.llm import chat_format, mixing, quality_classifier, quality_rules, topk_search, url_filter

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def test_url_rules_by_brute_force(spark):
    def host_path(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        return host, path

    def rule(h, p):
        fit = [(len(r), r, v) for r, v in RULES if (h == r[: r.index("/")] or h.endswith("." + r[: r.index("/")])) and p.startswith(r[r.index("/") :])]
        return max(fit)[1:] if fit else None

    rng = random.Random(0)
    bits = ["http", "://", "www.", "example.com", "EXAMPLE.net", "a.", "com", "/", "en/", "es/", "fr/", "?x=1&y=2", "#z", ":", "\n", "é", "x"]
    urls = [None, "", "://", "http://", *("".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(300)), *("http://" + "".join(rng.choice(bits[2:]) for _ in range(6)) for _ in range(400))]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        h, p = host_path(urls[r["page_id"]])
        want = rule(h, p)
        assert (r["host"], r["path"], r["rule"]) == (h, p, want and want[0]), urls[r["page_id"]]
        assert r["verdict"] == want[1] if want else r["verdict"] in ("allow", "block")


def _sites(n):
    """URLs of hosts under com (allowed), net (blocked) and org (no rule); the folders differ in how often they are blocked."""
    rng = random.Random(4)
    return [(k, f"http://s{rng.randrange(40)}.example.{('net', 'com', 'org')[k % 3]}/{rng.choice(('es', 'fr') if k % 3 == 0 else ('en', 'de', 'fr'))}/{k}{rng.choice(('', '.html', '?a=1'))}") for k in range(n)]


def test_suffix_statistics_cover_all_rows_and_leave_the_own_fold_out(spark):
    rules = (("com/", "allow"), ("net/", "block"))
    rows = spark.createDataFrame(_sites(600), "id long, url string")
    host, path = url_filter.url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("found", url_filter.longest_rule(rules))
    stats, overall, labelled = url_filter.learned_from(rows, 2)
    told = labelled.select("host", "first_folder", "label", "fold").collect()
    assert overall == sum(r["label"] for r in told) / len(told)
    got = {r["id"]: r["first_folder_rate"] for r in url_filter._with_statistics(labelled, stats, overall, True).collect()}
    for r in labelled.collect():
        like = [t["label"] for t in told if t["first_folder"] == r["first_folder"] and t["fold"] != r["fold"]]
        assert got[r["id"]] == pytest.approx((sum(like) + 2 * overall) / (len(like) + 2))


def test_trees_rank_urls_of_hosts_held_out(spark):
    rules = (("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
    rows = spark.createDataFrame(_sites(1500), "id long, url string")
    host, path = url_filter.url_parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("found", url_filter.longest_rule(rules))
    stats, overall, labelled = url_filter.learned_from(rows, 2)
    vectors = url_filter.training_vectors(labelled, stats, overall, 1000).withColumn("out", F.pmod(F.xxhash64("host"), F.lit(4)) == 0).cache()
    assert vectors.count() <= 1000
    model = url_filter.boosted_trees(vectors.filter("not out"), 2)
    from pyspark.ml.functions import vector_to_array

    told = model.transform(vectors.filter("out")).select("label", vector_to_array("probability")[1].alias("p")).collect()
    bad, good = ([r["p"] for r in told if r["label"] == x] for x in (1, 0))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.9
    used = [k for k, x in enumerate(model.featureImportances.toArray()) if x > 0.01]
    assert len(used) >= 3


def test_one_url_of_many_copies_does_not_fill_the_sample(spark):
    rows = [(k, "http://a.example.com/en/1") for k in range(300)] + [(1000 + k, f"http://b{k % 9}.net/es/{k}") for k in range(100)] + [(2000, "http://c.org/es/7")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), (("com/", "allow"), ("net/es/", "block")), sample=60).collect()
    assert len(got) == len(rows)
    assert 0 <= next(r["score"] for r in got if r["page_id"] == 2000) <= 1


def test_trees_learn_from_rules_and_bear_nothing(spark):
    urls = [(k, f"http://s{k % 7}.example.{('net', 'com')[k % 2]}/{('en', 'es', 'de')[k % 3]}/{k}") for k in range(300)]
    rows = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), RULES).collect()
    judged = [r for r in rows if r["rule"] is None]
    assert judged and all(0 <= r["score"] <= 1 for r in judged) and all(r["score"] is None for r in rows if r["rule"])
    none = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(none, RULES).collect()] == ["allow", "allow"]
    assert url_filter.judge(none.limit(0), RULES).count() == 0


@pytest.mark.parametrize("n, k", [(400, 20), (8, 20)])
def test_top_k_equals_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    v = [[float(x) for x in rng.normal(size=6)] for _ in range(n)]
    rows = [(i, v[i % (n // 2)], i) for i in range(n)]
    rows += [(1000, None, 0), (1020, [1.0, None], 0), (1040, [float("nan")] * 6, 0), (1060, [float("inf")] * 6, 0), (None, v[0], 0), (1080, [], 0), (1100, [1.0], 0), (0, v[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k).collect()
    fine = [(i, np.array([int(np.floor(64 * float(np.float32(x)))) for x in e] + [0] * (6 - len(e)))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            best = sorted((-int(q @ w), j) for b, (j, w) in enumerate(fine) if b != a)[:k]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.lit(True), k).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    big = [2.0**25, 1e9, -1e9, 2.0**40]
    rows = [(k, [float(k % 7), big[k % 4] if k % 3 == 0 else 1.0, -0.5]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    ends = np.iinfo(np.int64)
    want = []
    for i in range(0, 60, 20):
        best = sorted((-min(max(sum(a * b for a, b in zip(whole[i], w, strict=True)), ends.min), ends.max), j) for j, w in whole.items() if j != i)[:5]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_search_without_shard_bounds_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(500)], "vec_id long, embedding array<double>")
    first = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()
    monkeypatch.setattr(topk_search, "MOST_BOUNDS", 0)
    assert sorted(first) == sorted(topk_search.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())


def test_shard_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 300
    m = (centres[np.repeat(np.arange(20), 256)] + rng.normal(size=(5120, 16)) * 10).astype(np.int32)
    ids = np.arange(len(m))
    shard = topk_search.Shard(ids, ids, m)
    q, score, found, _ = shard.search(ids[:50], m[:50], np.full(50, np.iinfo(np.int64).min), 5)
    full = m[:50].astype(np.int64) @ m.T.astype(np.int64)
    full[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    for k in range(50):
        assert score[q == k].tolist() == np.sort(full[k])[::-1][:5].tolist()
    assert shard.opened < 0.5 * shard.possible
    big = np.full((1, 2), 2**30, np.int32)
    assert topk_search._product(big, big)[0, 0] == 2**61


def repeat_words(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})


def test_measurements_by_definition():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("ab#|") * rng.randrange(1, 3) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice(" \n\t") for w in words)
        m = dict(zip(quality_rules._MEASURES, quality_rules.measure(text), strict=True))
        lines = [x for x in text.split("\n") if x.strip()]
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
        assert m["n_symbols"] == sum(w.count("#") + w.count("|") for w in words)
        assert m["n_dup_lines"] == sum(x in lines[:k] for k, x in enumerate(lines))
        assert m["n_repeat_words"] == repeat_words(words)
    assert quality_rules.repeat_words([b"%d" % (k % 3000) for k in range(9000)]) == 9000


def test_ledger_policies_and_ablations(spark, odd, empty):
    rows = quality_rules.ledger(odd).collect()
    assert len(rows) == 11 and all(r["failed"] & 1 for r in rows if r["n_words"] < 10)
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "7", "8", "None"]
    assert quality_rules.ledger(empty).count() == quality_rules.keep(empty).count() == 0
    effects = {(r["version"], r["rule"]): r for r in quality_rules.ablations(quality_rules.ledger(odd)).collect()}
    assert effects[("base", "too_few_words")]["n_kept"] == 6 and effects[("base", "too_few_words")]["n_kept_without"] == 11
    junk = [" ".join(w + "$$$" for w in prose(1).split()), " | ".join(prose(2).split()), prose(3).upper(), " ".join(w for w in prose(4, 20).split() for _ in range(5)), "!! ".join(prose(5).split())]
    assert quality_rules.keep(spark.createDataFrame([document(k, t) for k, t in enumerate(junk)], DOCS)).count() == 0


def test_chats_round_trip(spark):
    rng = random.Random(4)
    bits = ["\\", "#", "##", "<", "</turn>", "<turn/>", ":", ": ", "\n", "a", "\U0001f600", "### a: ", "/turn>\n", " ", "### user: x</turn>\n"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])
    rows = [(i // 6 if i < 600 else None, i % 6, rng.choice(["assistant", "user", None, text()]), text()) for i in range(606)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat_format.format_chats(df).withColumns({"turns": chat_format.read_turns(), "loss": chat_format.read_loss_text()}).collect()
    assert len(out) == 101
    for r in out:
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert sum(s["length"] for s in r["loss_spans"]) <= len(r["formatted"])
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "c")], df.schema)
    one = chat_format.format_chats(tied).collect()[0]["formatted"]
    assert one == "### user: c<turn/>a<turn/>a<turn/>b</turn>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_mix_meets_targets(spark, odd, empty):
    rows = [document(k, prose(k, 5 + k % 90), (None, "a", "b", "c", "d")[min(4, k % 9)]) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in rows}
    total = sum(r["size"] for r in out)
    by: dict = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(source[r["doc_id"]], [r["target"], r["source_size"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    assert all(abs(t - taken) <= 1 and size == own and t <= 2 * size + 1e-6 for t, size, taken, own in by.values())
    assert abs(sum(s[0] for s in by.values()) - 1.5 * total) < 1e-6
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in out)
    assert mixing.mix(odd).count() == 11 and mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_keep_rows_without_or_with_shared_ids(spark):
    import collections

    rows = [document(None, prose(k, 40), "ab"[k % 2]) for k in range(120)] + [document(7, prose(200 + k, 40), "ab"[k % 2]) for k in range(40)]
    rows += [document(None, prose(0, 40), "a")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["source_size"])] += r["taken"]
    size = {s: sum(40 for r in rows if r[3] == s) for s in "ab"}
    got, whole = collections.Counter(), collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        n = len(r["text"].split())
        got[(r["doc_id"], size[r["source"]])] += n
        whole[(r["doc_id"], r["text"], r["source"])] += n == 40
    assert got == want and got[(None, size["a"])] > 0 and size["a"] != size["b"]
    there = collections.Counter((r[0], r[1], r[3]) for r in rows)
    assert all(n <= 2 * there[k] for k, n in whole.items())


def test_targets_and_flow():
    assert mixing.shared_targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.shared_targets([0, 10], [5, 1], 3, 2) == [0.0, 20]
    flow = mixing.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [18, 20], 2)
    assert sum(f.get(0, 0) for f in flow) == 18 and sum(f.get(1, 0) for f in flow) == 20
    assert all(sum(f.values()) <= 2 * c for f, c in zip(flow, [10, 10, 5], strict=True))


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, prose(k, 20), ["a", "b"][: 1 + k % 2] if k % 3 else ["b"]) for k in range(90)], "doc_id long, text string, sources array<string>")
    out = mixing.mix(docs, weights=(1, 1), source=F.col("sources")).collect()
    assert sum(r["taken"] for r in out) == round(1.5 * sum(r["size"] for r in out))


def test_classifier_learns_held_out(spark, odd, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.3
        text = prose(1000 + k, 40)
        rows.append(document(k, " ".join(w + "%%" for w in text.split()) if bad else text))
        labels.append((k, int(not bad), 0))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs, marks).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    right = [r["predicted"] == labels[k][1] for k, r in out.items() if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    got = quality_classifier.classify(odd, marks).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(empty, marks.limit(0)).count() == 0
    assert {r["score"] for r in quality_classifier.classify(odd, marks.limit(0)).collect()} == {0.5}


def test_classifier_learns_one_row_per_id(spark):
    rows = [(k, prose(k, 30)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [(3, None)] + rows[:9] * 200, "doc_id long, text string").filter("text is not null")
    assert quality_classifier.fit(once, labels) == quality_classifier.fit(often, labels)
    two = spark.createDataFrame(rows + [(3, "other words")], "doc_id long, text string")
    assert quality_classifier.fit(two, labels) == quality_classifier.fit(two.repartition(5), labels)
