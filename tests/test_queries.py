"""Every indexing query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from quillmill.plans import flows, queries

QUERIES, ORACLE = queries.QUERIES | flows.QUERIES, queries.ORACLE | flows.ORACLE
DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DIR}/{file}'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda some: sorted(repr([x for x in r]) for r in some)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_repeated_keys_keep_the_last_written(spark):
    """Of rows with one key the last by the given order stays, not that of the greatest content."""
    from quillmill.operators.publication import upsert_chunks

    documents = spark.createDataFrame([(1, 7)], "id long, tenant_id long")
    held = spark.createDataFrame([(1, 11, 7, 0, "old"), (1, 11, 7, 1, "stays")], "document_id long, document_version_id long, tenant_id long, chunk_no int, content string")
    new = spark.createDataFrame([(1, 11, 0, "z", 1), (1, 11, 0, "a", 2), (1, 11, 0, "m", None)], "document_id long, document_version_id long, chunk_no int, content string, seq int")
    of = lambda **how: sorted((r["chunk_no"], r["content"]) for r in upsert_chunks(held, new, documents, **how).collect())
    assert of(order="seq") == [(0, "a"), (1, "stays")]
    assert of() == [(0, "z"), (1, "stays")]
