"""Every registered query of the problems over the small tables."""

import os

import pytest

from textloom.llm import queries as Q
from textloom.llm import sql
from textloom.session import load

DATA = os.environ.get("TEXTLOOM_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p1_found": ["alignment_key", "component_key"],
    "p3_found": ["record_table", "left_id", "right_id"],
    "p4_found": ["candidate_id"],
    "p5_found": ["left_id", "right_id"],
    "p6_found": ["candidate_id"],
    "p7_found": ["id", "defect_type"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["left_doc_id", "right_doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs_over_whole_tables(spark, name):
    frame = Q.queries()[name](spark, DATA)
    rows = frame.collect()
    assert frame.columns == COLUMNS.get(name, frame.columns)
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    link = duckdb.connect()
    for table in os.listdir(DATA):
        if table.endswith(".parquet"):
            link.execute(f"create view {table[:-8]} as select * from '{DATA}/{table}'")
    for name, text in sql.oracle_sql().items():
        assert sorted(map(tuple, Q.queries()[name](spark, DATA).collect())) == sorted(link.execute(text).fetchall())


def test_what_is_tied_shares_a_split(spark):
    given = {(r.record_table, r.record_id): r.split for r in Q.p1_splits(spark, DATA).collect()}
    tied = {}
    for r in load(spark, DATA, "locale_records").collect():
        if r.alignment_key:
            record = "|".join(x for x in (r.lang, r.source_record_id) if x)
            tied.setdefault(("k", r.alignment_key.strip().lower()), set()).add(given["locale_records", record])
    for r in load(spark, DATA, "encoded_samples").collect():
        for key in (("g", r.sample_group_id), ("k", (r.provenance.alignment_key or "").strip().lower())):
            if key[1]:
                tied.setdefault(key, set()).add(given["encoded_samples", r.sample_id])
    assert all(len(found) == 1 for found in tied.values())


def test_every_document_has_ids(spark):
    documents = load(spark, DATA, "documents")
    got = {r.doc_id: len(r.ids) for r in Q.p8_ids(spark, DATA).collect()}
    assert got.keys() == {r.doc_id for r in documents.select("doc_id").collect()}
    assert all((got[r.doc_id] == 0) == (not r.text) for r in documents.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", ["p1_splits", "p2_records", "p3_found", "p4_found", "p5_matches", "p6_shares", "p7_found", "p8_ids", "p9_found", "p10_shares"])
def test_batches_do_not_matter(spark, name):
    """Tasks of many Arrow batches give what tasks of one give."""
    first = sorted(map(repr, Q.queries()[name](spark, DATA).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(repr, Q.queries()[name](spark, DATA).collect())) == first
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def tied(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_classes_are_those_of_the_pairs(spark):
    pairs = {(r.left_doc_id, r.right_doc_id) for r in Q.p10_found(spark, DATA).collect()}
    rows = Q.p10_classes(spark, DATA).collect()
    assert {r.doc_id: r.class_id for r in rows} == tied(pairs) and len(rows) == len({r.doc_id for r in rows}) > 0
    pairs = {(r.left_id, r.right_id) for r in Q.p5_matches(spark, DATA).collect()}
    rows = Q.p5_classes(spark, DATA).collect()
    assert {r.entry_id for r in rows} == set(tied(pairs)) and len(rows) == len({r.entry_id for r in rows}) > 0
    by_class, by_pairs = {}, {}
    for r in rows:
        by_class.setdefault(r.class_id, set()).add(r.entry_id)
    for k, c in tied(pairs).items():
        by_pairs.setdefault(c, set()).add(k)
    assert all(any(p <= c for c in by_class.values()) for p in by_pairs.values())  # entries of one side and one form are one class as well
    pairs = {(r.record_table, x) for r in Q.p3_found(spark, DATA).collect() for x in (r.left_id, r.right_id)}
    assert {(r.record_table, r.record_id) for r in Q.p3_classes(spark, DATA).collect()} == pairs
