import corpus_pipeline
from conftest_llm import DOCS, document, prose

from formlake.llm import queries


def test_stages_keep_columns_and_clean_documents(spark):
    rows = [document(k, prose(k, 80), f"src{k % 3}") for k in range(40)]
    rows += [document(100, prose(7, 80)), document(101, "too short"), document(102, " | ".join(prose(1, 30).split()))]
    docs = spark.createDataFrame(rows, DOCS)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialise(out, "t")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(40))
    assert seen[0] == clean | {100} and seen[1] == seen[0]
    assert clean <= seen[2] | {7, 100} and seen[3] <= seen[2] and seen[4] == seen[3]


CLASHES = ("row", "doc", "id", "t_id", "part", "size", "taken", "nth", "pattern", "group", "__row__", "__keep__", "__nth__", "__taken__", "__size__", "__part__", "node", "n", "n_words", "failed", "line", "ord", "key", "keys", "g", "k")


def test_stages_take_nulls_repeats_and_clashing_names(spark):
    rows = [document(k, prose(k, 80), f"src{k % 3}")[:5] for k in range(24)]
    rows += rows[:3] + [document(50, None)[:5], document(51, "")[:5], document(None, prose(60, 80))[:5], document(53, prose(61, 80), None)[:5], (None,) * 5, document(3, prose(62, 80))[:5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *(f"{c}-{k}" for c in CLASHES)) for k, r in enumerate(rows)], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            got = corpus_pipeline.materialise(out, "t")
            assert {r["node"] for r in got.collect()} <= {r["node"] for r in docs.collect()}, "extra columns pass through"
        docs = got if k < len(corpus_pipeline.STAGES) - 1 else out
    assert {r["doc_id"] for r in docs.collect()} >= {k for k in range(24) if k % 3 == 0} - {3}
    nothing = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, "").count() == 0
    assert corpus_pipeline.packed(spark, nothing, "").count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2 : n.index("_")]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(queries.oracle_sql()) <= set(queries.queries())
