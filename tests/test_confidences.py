"""Scores of fields by their tokens: token rows and tokens within the page's row agree."""

import math
import random

from pyspark.sql import functions as F

from formlake.functions import json_fields
from formlake.operators import flags

FIELDS = ("a", "b", "c")


def test_token_rows_and_arrays_agree(spark):
    raws = {1: '{"a": "x€y", "b": ""}', 2: '{"a": 12, "a": [1, 2]}', 3: None, 4: '{"a": "😀 z"}', 5: '{"b": "q"}'}
    tokens = [(k, 2 * i, raw[i : i + 3], None if i == 6 else -i / 8) for k, raw in raws.items() if raw for i in range(0, len(raw), 3)]
    tokens += [(4, 3, "", -9.0), (4, 5, None, -0.5)]
    tokens = [(k, p, "?" if k == 5 and p == 0 else t, q) for k, p, t, q in tokens]
    values = [(1, "a", "x€y"), (1, "b", ""), (2, "a", "1 2"), (4, "a", "z"), (5, "b", "q"), (9, "a", "x")]
    pages = spark.createDataFrame(list(raws.items()), "doc_id long, raw string")
    rows = spark.createDataFrame(tokens, "doc_id long, pos int, text string, logp double")
    stored = spark.createDataFrame(values, "doc_id long, field string, value string")
    columns = ["doc_id", "field", "span", "n_tokens", "conf_min", "conf_first", "conf_mean", "span_matches_value"]
    by_rows = sorted(map(tuple, flags.field_confidences(pages, rows, stored, FIELDS).select(columns).collect()))
    arrays = rows.orderBy("pos").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "logp"))), lambda t: t.dropFields("pos")).alias("tokens"))
    by_pages = sorted(map(tuple, flags.page_confidences(pages.join(arrays, "doc_id", "left"), stored.groupBy("doc_id").agg(F.collect_list(F.struct("field", "value")).alias("stored")), FIELDS).select(columns).collect()))
    assert repr(by_rows) == repr(by_pages) and len(by_rows) == len(raws) * len(FIELDS)
    got = {r[:2]: r[2:] for r in by_rows}
    for (k, field), (span, n, least, first, mean, same) in got.items():
        raw = raws[k] or ""
        told = "".join(t or "" for d, _, t, _ in sorted(tokens, key=lambda t: t[:2]) if d == k)
        if told != raw:
            assert (span, n, least, same) == ("decode_mismatch", 0, None, False)
            continue
        texts = {(1, "a"): "x€y", (1, "b"): '""', (2, "a"): "[1, 2]", (4, "a"): "😀 z"}
        if (k, field) not in texts:
            assert (span, n, least, same) == ("missing", 0, None, False)
            continue
        s = raw.rindex(texts[k, field])
        e, at, touched = s + len(texts[k, field]), 0, []
        for _, _, t, q in sorted((t for t in tokens if t[0] == k), key=lambda t: t[1]):
            if at < e and at + len(t or "") > s and q is not None:
                touched.append(q)
            at += len(t or "")
        assert n == len(touched) and math.isclose(least, math.exp(min(touched))) and math.isclose(first, math.exp(touched[0])) and math.isclose(mean, math.exp(sum(touched) / n))
        assert same == ((k, field) != (4, "a"))


def test_text_spans_are_value_spans(spark):
    pieces = ['"k"', '"k" : ', '"k":"', "[", "]", '"', "\\", "\\\"", "😀", "\u00a0", "\u2028", " ", "\n", "\t\x1c", "a", "1", ",", "}", '"k"\v:\f']
    draw = random.Random(4)
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(2000)] + ['"k": "a" , "k": "a"', '"k":', '"k": "k": 1', "😀\"k\": \"x\\\"y\", "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_fields.value_span(F.col("t"), "k").alias("v")).collect()
    spans = json_fields.text_spans(["k"])
    for t, v in rows:
        [own] = spans(t)
        assert (own and (*own[:3], own[1] - own[3], own[2] + own[3], t[own[1] : own[2]])) == (v and tuple(v)), t
