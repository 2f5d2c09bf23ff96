import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import document, prose
from formlake.llm import filter_audit, token_counts, whitening
from formlake.llm.queries import tokenizer_file

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def replayed(rows, labels, names="ABCDE"):
    """Counts by (part, order, step), from a plain reading of the conditions."""
    quality, toxic = {}, {}
    for d, q, t in labels:
        if d is None:
            continue  # a null id is equal to none
        quality[d], toxic[d] = quality.get(d) or q == 1, toxic.get(d) or t == 1

    def fails(row):
        text = row[1] or ""
        words = BLANK.findall(text)
        copy = row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in rows)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": copy,
        }

    told = [(r[2] or "", fails(r), bool(quality.get(r[0])), bool(toxic.get(r[0]))) for r in rows]
    out, removed_by = {}, {}
    for part in {t[0] for t in told}:
        for order in permutations(names):
            left = [t for t in told if t[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [t for t in left if t[1][name]]
                left = [t for t in left if not t[1][name]]
                redundant = sum(t[1][name] for t in gone)
                gone += here
                alone = sum(t[1][name] and sum(t[1].values()) == 1 for t in told if t[0] == part)
                out[part, "".join(order), step] = [len(left), len(here), redundant, alone, sum(t[2] for t in here), sum(t[3] for t in here)]
                removed_by[part, name] = removed_by.get((part, name), 0) + len(here)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def counts(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_by_brute_force(spark, odd_rows):
    rng = random.Random(2)
    rows = list(odd_rows)
    for k in range(20, 140):
        text = rng.choice([prose(k, rng.choice((20, 250))), prose(3, 210), "same words " * rng.choice((3, 120)), "UPPER Case " + prose(k, 199), prose(k, 205) + " #tag", ""])
        rows.append((k, text, rng.choice(("en", "de", None, "")), None, 1, "x", 1, "y", 2))
    rows += rows[30:36]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 130, 2) for _ in range(rng.choice((1, 1, 2)))] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, part int, n_words string, failed int").repartition(3)
    got = counts(filter_audit.audit(docs, labelled(spark, labels)))
    assert got == replayed(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing_and_without_labels(spark, empty, odd):
    assert counts(filter_audit.audit(empty, labelled(spark, []))) == {}
    got = counts(filter_audit.audit(odd, labelled(spark, [])))
    assert got and all(v[4:6] == (0, 0) for v in got.values())


def test_audit_with_other_filters(spark, odd, odd_rows):
    got = counts(filter_audit.audit(odd, labelled(spark, []), F.lit("all"), {"x": "n_chars = 0", "y": "n_words < 1"}))
    n = len(odd_rows)
    nothing = sum(not r[1] for r in odd_rows)
    blank = sum(not BLANK.search(r[1] or "") for r in odd_rows)
    assert got["all", "xy", 1][:2] == (n - nothing, nothing) and got["all", "xy", 2][:3] == (n - blank, blank - nothing, nothing)
    with pytest.raises(ValueError):
        filter_audit.orders(spark, list("abcdefg"))


SIGNS = ["a", "B", "é", "é", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "　", "'s", "'", "1", "22", "٣", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "ß", "İ", "漢字", "😀", "▁", "_", "-", "the", "The", "‍", "\x00", "\r\n", "Å", "ﬁ"]


def library(name):
    path = tokenizer_file(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return lambda x: len(p.encode(x))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("size", [4, 60, 1 << 21])
def test_counts_are_the_librarys(monkeypatch, name, size):
    """Small limits make every kind of cut happen often."""
    monkeypatch.setattr(token_counts, "SLICE", size)
    monkeypatch.setattr(token_counts, "CALL", size)
    monkeypatch.setattr(token_counts, "HELD", 40 if size == 60 else 1000)
    monkeypatch.setattr(token_counts, "_LONGEST", 6)
    token_counts._COUNTERS.clear()
    rng = random.Random(size)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(16))) for _ in range(1500)] + [prose(1, 400), "x" * 5000, "é" * 300 + "7" * 300]
    want = library(name)
    assert token_counts.counter(tokenizer_file(name)).lengths(texts) == list(map(want, texts))
    token_counts._COUNTERS.clear()


def test_count_query_on_odd_rows(spark, odd, odd_rows, empty):
    want = library("word_bpe_49k.json")
    got = token_counts.count_tokens(odd, tokenizer_file("word_bpe_49k.json"), limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    told = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), want(r[1] or ""), want(r[1] or "") > 100) for r in odd_rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == told
    assert token_counts.count_tokens(empty, tokenizer_file("word_bpe_49k.json")).count() == 0
    words = spark.createDataFrame([("k", "two words")], "doc_id string, text string")
    assert token_counts.count_tokens(words, tokenizer_file("word_bpe_49k.json")).first()["doc_id"] == "k"
    with pytest.raises(ValueError):
        token_counts.counter("ids.txt")


def exact(vectors, scale=64, offset=1_000_000):
    """(x by row or None, fit list, n, S, n^2 V) in Python's integers."""
    import math

    rows = []
    for v in vectors:
        fine = v is not None and all(c is not None and math.isfinite(c) for c in v)
        rows.append([math.floor(scale * c) + offset for c in v] if fine else None)
    width = max((len(r) for r in rows if r is not None), default=0)
    rows = [r and r + [offset] * (width - len(r)) if r is not None else None for r in rows]
    fit = sorted({tuple(r or [offset] * width) for r in rows if r is not None})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) for j in range(width)] for i in range(width)]  # n^3 V
    return rows, fit, n, s, v


def whitened(spark, vectors, kind="array<float>", **options):
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], f"vec_id long, embedding {kind}, n string").repartition(3)
    out = {}
    for r in whitening.whiten(df, **options).collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def checked(got, vectors):
    rows, fit, n, s, v = exact(vectors)
    cov = np.array([[float(Fraction(c, n**3)) for c in row] for row in v])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert set(got) == {k for k, r in enumerate(rows) if r is not None}
    for k, parts in got.items():
        x = rows[k] or list(fit[0])
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        for c, r in parts.items():
            assert (r["n"], int(r["deviation"])) == (n, dev)
            assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            assert abs(r["whitened"]) == pytest.approx(abs(centred @ u[:, c - 1]) / e[c - 1] ** 0.5, rel=1e-6, abs=1e-7)
    return e


def test_whitening_by_brute_force(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1 + k) for k in range(6)] for _ in range(90)]
    vectors += vectors[:7] + [vectors[0]] * 40 + [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.5, -2.0]]
    got = whitened(spark, vectors)
    checked(got, [v and [c if c is None else float(np.float32(c)) for c in v] for v in vectors])
    assert all(set(p) == set(range(1, 7)) for p in got.values())
    assert all(set(p) == {1, 2} for p in whitened(spark, vectors, components=2).values())


def test_whitening_of_large_components(spark):
    rng = random.Random(6)
    vectors = [[rng.uniform(-1, 1) * 2.0**44, rng.uniform(-1, 1) * 2.0**45, 2.0**40] for _ in range(30)]
    got = whitened(spark, vectors, "array<double>")
    checked(got, vectors)
    assert all(set(p) == {1, 2} for p in got.values()), "the third component never varies"
    far = whitened(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 2.0]], "array<double>")
    assert len(far) == 3 and all(np.isfinite(r["whitened"]) for p in far.values() for r in p.values())


def test_whitening_without_variation(spark):
    assert whitened(spark, []) == {}
    assert whitened(spark, [None, [None]]) == {}
    assert whitened(spark, [[1.0, 2.0]] * 5) == {}
    assert whitened(spark, [[], []]) == {}


def test_limb_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 15, 1 << 17, 1 << 40, (1 << 62) - 1):
        x = rng.integers(-high, high, (50, 4), endpoint=True)
        x[0] = -high, high, 0, 1
        gram = whitening.Gram(4)
        gram.add(x)
        gram.add(x[:7])
        want = sum(np.outer(r, r) for r in [*x.astype(object), *x[:7].astype(object)])
        assert (gram.flush() == want).all()
        for v in gram.whole.ravel():
            assert sum(d << 32 * k for k, d in enumerate(whitening._digits(int(v)))) == v


def test_audit_digest_is_of_the_whole_text(spark):
    rows = [document(1, "a" * 100_000 + "x"), document(2, "a" * 100_000 + "y"), document(3, "a" * 100_000 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, size int, n_lines string, failed int")
    got = {r["id"]: (r["is_copy"], r["digest"]) for r in filter_audit.with_copies(filter_audit.measured(docs, "lang")).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == [False, False, True]
    assert bytes(got[2][1]) == hashlib.sha256(rows[1][1].encode()).digest()
