"""Every query over the small tables against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spanfold import cases, queries, relational

QUERIES = queries.QUERIES | relational.QUERIES | cases.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | relational.ORACLE_SQL | cases.ORACLE_SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    answer = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in answer.fetchall())


def test_the_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert len(QUERIES) == len(queries.QUERIES) + len(relational.QUERIES) + len(cases.QUERIES)


def test_disagreements_are_those_of_bags(spark):
    """As EXCEPT ALL both ways has them: rows that occur more often on one side, and null ids, count; a query without rows has its row."""
    held = spark.createDataFrame([(1, True), (2, True), (2, True), (None, True), (4, False), (None, None)], "doc_id bigint, hit boolean")
    found = {"some": [1, 2, 3, 3], "none": [], "null": [None, 4]}
    ids = {name: spark.createDataFrame([(x,) for x in xs], "doc_id bigint") for name, xs in found.items()}
    tests = {"some": F.col("hit"), "none": F.lit(False), "null": F.col("doc_id").isNull()}
    got = queries.disagreements(spark, ids, held, tests)
    assert sorted(tuple(r) for r in got.collect()) == [("none", 0, 0), ("null", 2, 2), ("some", 4, 4)]
    assert got.dtypes == [("query", "string"), ("matches", "bigint"), ("disagreements", "bigint")]
