"""Recognition of arriving pages: retries, dead letters, restarts."""

import json

import pytest

from formlake.streaming import ingest, recognition

FIELDS = ["number", "name"]


def engine():
    def read(page, strict):
        if page == "broken":
            raise RuntimeError("no image")
        if page == "never":
            return "nothing to see", 3
        if page == "late" and not strict:
            return "{half", 4
        return page if page.startswith("{") else '{"number": 0123, "name": ["a", "b"], "more": 1}', 5

    return read


def arrive(spark, folder, pages):
    spark.createDataFrame(pages, recognition.PAGES).coalesce(1).write.mode("append").json(folder)


def test_a_stricter_second_try(spark):
    pages = [(1, "late"), (2, "never"), (3, "broken"), (4, '{"number": null, "name": {"x": 1}}'), (5, "fine"), (None, "fine"), (6, '{"name": "ü \\" , }"}')]
    got = {r["doc_id"]: r for r in recognition.recognised(spark.createDataFrame(pages, recognition.PAGES).repartition(3), engine, FIELDS).collect()}
    assert len(got) == 7
    assert (got[1]["values"], got[1]["attempts"], got[1]["error"], got[1]["extra_keys"]) == ({"number": "0123", "name": "a b"}, 2, None, "more")
    assert got[2]["attempts"] == 2 and got[2]["error"].startswith("ValueError") and got[2]["raw"] == "nothing to see"
    assert got[3]["error"] == "RuntimeError: no image" and got[3]["values"] == {"number": "", "name": ""} and got[3]["raw"] is None
    assert got[4]["values"] == {"number": "", "name": ""} and got[4]["error"] is None and got[4]["attempts"] == 1
    assert got[5]["values"] == got[None]["values"] and got[6]["values"]["name"] == 'ü " , }'
    log = {r["doc_id"]: (r["parsed"], r["n_empty"]) for r in recognition.run_log(recognition.recognised(spark.createDataFrame(pages, recognition.PAGES), engine, FIELDS)).collect()}
    assert log == {1: (True, 0), 2: (False, 2), 3: (False, 2), 4: (True, 2), 5: (True, 0), None: (True, 0), 6: (True, 1)}


def test_answers_are_texts():
    assert recognition.answer_fields('say {"number": 007.50 , "name": "x"} ok', FIELDS) == ({"number": "007.50", "name": "x"}, [])
    assert recognition.answer_fields(json.dumps({"number": [1, 2], "z": 1, "a": 2}), FIELDS) == ({"number": "1 2", "name": ""}, ["a", "z"])
    with pytest.raises(ValueError):
        recognition.answer_fields("} {", FIELDS)


def test_restarts_lose_and_double_nothing(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(0, 12, 3):
        arrive(spark, landing, [(k, "fine"), (k + 1, "never"), (k + 2, "late")])
    fails = iter((0, 2))
    due = [next(fails)]

    def crash(number):
        if due and number == due[0]:
            due[:] = [x for x in [next(fails, None)] if x is not None]
            raise RuntimeError("the driver is lost")

    def run():
        return recognition.recognise_new_pages(spark, landing, out, mark, engine, FIELDS, files=1, written=crash)

    for _ in range(2):
        with pytest.raises(Exception, match="the driver is lost"):
            run()
    assert run() == {"pages": 6, "failed": 2}, "batches 2 and 3 were left"
    assert run() == {"pages": 0, "failed": 0}
    ids = sorted(r["doc_id"] for r in recognition.results(spark, out).collect())
    assert ids == list(range(12))
    letters = spark.read.parquet(out + "/dead_letters").collect()
    assert sorted(r["doc_id"] for r in letters) == [1, 4, 7, 10] and all(r["raw"] == "nothing to see" for r in letters)
    arrive(spark, landing, [(50, "fine")])
    assert run() == {"pages": 1, "failed": 0} and recognition.results(spark, out).count() == 13


def test_ingest_counts_every_batch(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(k, "a") for k in range(105)], ingest.RAW).repartition(105).write.json(landing)
    assert ingest.parse_new_pages(spark, landing, out, mark, files=1) == 105
