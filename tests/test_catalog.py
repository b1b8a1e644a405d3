import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
# The slow ones are checked at the larger scale by tools/check.py.
SLOW = {"hnsw_topk", "ann_recall_vs_flat", "ivf_pq_topk"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{contract.SMOKE_DIR}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in SLOW and n in contract.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    frame = contract.queries()[name](spark, contract.SMOKE_DIR)
    relation = duck.sql(contract.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    got, want = canonical(frame.columns, frame.collect()), canonical(relation.columns, relation.fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
