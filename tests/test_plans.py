"""Every query against its SQL on the small tables, and independence of partitioning."""

import datetime
import decimal
import math
import os

import pytest

from textloom.plans import registry

DATA = os.environ.get("TEXTLOOM_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    link = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            path = os.path.join(DATA, name)
            link.execute(f"create view {name[:-8]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return link


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    answer = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in answer.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["route_sample", "stratified_interleave", "greedy_dedup", "budget_fill", "token_batches", "dedup_reasons"])
def test_partitioning_does_not_matter(spark, name):
    query = registry.queries()[name]
    first = sorted(map(repr, query(spark, DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert sorted(map(repr, query(spark, DATA).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
