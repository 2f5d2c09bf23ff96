"""Texts and dates against plain loops."""

import random
import string

from pyspark.sql import functions as F

from formlake.functions import dates, text


def run(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    return [r["o"] for r in rows.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_formulas_nested_to_any_depth(spark):
    rng = random.Random(1)
    pairs = [("\\[", "\\]"), ("\\(", "\\)"), ("$$", "$$"), ("<math b='1'>", "</MATH>"), ("$", "$")]
    nests = []
    for depth in (0, 1, 4, 10, 25):
        for _ in range(8):
            chosen = [rng.choice(pairs[:4] if depth > 1 else pairs) for _ in range(depth)]
            chosen = [p for k, p in enumerate(chosen) if p[0] != "$$" or all(q[0] != "$$" for q in chosen[:k])]
            nests.append("".join(o + " \n"[k % 2] for k, (o, _) in enumerate(chosen)) + "7 a" + "".join(c for _, c in reversed(chosen)))
    assert run(spark, text.clean_text, nests) == ["7 a"] * len(nests)
    assert run(spark, text.without_formulas, ["a \\] b", "cost $7", "$1\n$", None, ""]) == ["a   b", "cost $7", "$1\n$", None, ""]


def test_struck_out_values(spark):
    on, off = text.STRUCK, text.UNSTRUCK
    given = [f"{on}99050{off} Ulm", f"{on}Ann Lee{off}", f": {on}a{off} - {on}b{off} |", f"a{on}{off}", None, "", f"{on}x{off} ☐"]
    assert run(spark, text.clean_value, given) == ["Ulm", "Ann Lee", "a - b", "a", None, "", ""]
    assert run(spark, text.with_struck_text, given[:2]) == ["99050 Ulm", "Ann Lee"]


def test_values_of_signs_only(spark):
    signs = " \t :.-–—|_*[]xX✕✓☐☑☒□❑ab"
    rng = random.Random(2)
    values = ["".join(rng.choice(signs) for _ in range(rng.randrange(7))) for _ in range(1500)]

    def plain(v):
        v = v.strip(" \t ").lstrip(" \t :.-–—|_*").rstrip(" \t :|_*")
        rest, boxes = v, 0
        while rest:
            if rest[0] in " \t ☐☑☒□❑":
                rest = rest[1:]
            elif rest[0] == "[" and "]" in rest and rest[1 : rest.index("]")].strip(" \t") in ("", *text.TICKS):
                rest = rest[rest.index("]") + 1 :]
            else:
                return v.strip(" \t ")
            boxes += 1
        return ""

    assert run(spark, text.clean_value, values) == list(map(plain, values))


def test_spelled_dates_by_trying_all_cuts(spark):
    letters = string.ascii_letters + "ÄÖÜäöüß"
    rng = random.Random(3)
    values = ["".join(rng.choice(["5", "1", "l", "M", "ai", "Mai", ".", " ", "Juni", "98", "2", "O", "-", "x ", "\t"]) for _ in range(rng.randrange(9))) for _ in range(3000)]

    def plain(v):
        v = v.strip()
        fits = lambda x, low, high: low <= len(x) <= high and all(c in letters or c in string.digits for c in x)
        for day in (2, 1):
            rest = v[day:]
            rest = (rest[1:] if rest.startswith(".") else rest).lstrip()
            for year in (2, 3, 4):
                word = rest[:-year].rstrip()
                if fits(v[:day], day, day) and fits(rest[-year:], year, year) and len(word) >= 3 and all(c in letters for c in word):
                    return v[:day], word, rest[-year:]
        return None

    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    got = [r["p"] and tuple(r["p"]) for r in rows.select("k", dates._spelled_parts(F.trim(F.btrim("v", F.lit(" \t")))).alias("p")).orderBy("k").collect()]
    assert got == list(map(plain, values)) and sum(map(bool, got)) > 100


def test_numeric_dates(spark):
    given = ["1.2.1999", "31.02.1999", "29-2/2000", "01.13.99", "1.1.0", "1.1.00", "001.1.2000", "1.1.20000", "1..2000", "x.1.2000", "1.1.2000.", "", None, "29.02.1900"]
    assert run(spark, dates.numeric_date, given) == [True, False, True, False, False, True, False, False, False, False, False, False, False, False]
