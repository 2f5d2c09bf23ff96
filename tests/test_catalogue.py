"""Every query against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from formlake import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(float(v)) if hasattr(v, "as_tuple") else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in catalogue.oracle_sql():
        cursor = duck.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_oracles_name_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).columns == ["field", "n_changed", "share"]


def _against_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute("set threads = 1")
    for file in os.listdir(folder):
        c.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    cursor = c.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in catalogue.queries()[name](spark, str(folder)).collect())
    assert expected and got == expected


@pytest.mark.parametrize("name", ["c01_diff_cells", "d01_changes_by_field", "s01_union_corrected", "p04_json_fewshot", "p12_value_spans", "j08_field_confidences", "h06_json_quote_bare"])
def test_long_keys_stay_whole(spark, tmp_path, name):
    keys = "99997, 99998, 99999, 100000, 100001, 100005, 100010, 123456, 9999999, 10000005, 15000017, 100000002, 510000011"
    duckdb.execute(f"copy (select unnest([{keys}])::bigint as o_orderkey, 1::bigint as o_custkey, 'F' as o_orderstatus, 1.5 as o_totalprice, timestamp '1995-11-21 00:00:00' as o_orderdate, '1-URGENT' as o_orderpriority) to '{tmp_path}/orders.parquet' (format parquet)")
    _against_sql(spark, tmp_path, name)


def test_first_of_repeated_line_numbers(spark, tmp_path):
    """Tokens at the same place: the first in the table counts, however the rows are dealt out."""
    duckdb.execute(f"copy (select i::bigint as o_orderkey from range(2000) t(i)) to '{tmp_path}/orders.parquet' (format parquet)")
    lines = "select (i * 7 % 2000)::bigint as l_orderkey, (1 + i // 2000 % 3)::int as l_linenumber, (i * 13 % 101) / 1000.0::double as l_discount from range(24000) t(i)"
    duckdb.execute(f"copy ({lines}) to '{tmp_path}/lineitem.parquet' (format parquet, row_group_size 500)")
    dealt = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3"}
    before = {k: spark.conf.get(k) for k in dealt}
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        _against_sql(spark, tmp_path, "j03_interval_overlap")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_field_confidences_broadcast_nothing(spark):
    plan = catalogue.queries()["j08_field_confidences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_first_token_with_a_score(spark, tmp_path):
    """A token without a score is not the first one of its span."""
    duckdb.execute(f"copy (select unnest([1, 2, 14])::bigint as o_orderkey) to '{tmp_path}/orders.parquet' (format parquet)")
    lines = "values (14, 1, null), (14, 2, 0.25), (14, 1, null), (14, 2, 0.5), (2, 1, null), (2, 1, null)"
    duckdb.execute(f"copy (select a::bigint as l_orderkey, b::int as l_linenumber, c::double as l_discount from ({lines}) t(a, b, c)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    _against_sql(spark, tmp_path, "j03_interval_overlap")


def test_field_confidences_shuffle_pages_not_tokens(spark):
    plan = catalogue.queries()["j08_field_confidences"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1
