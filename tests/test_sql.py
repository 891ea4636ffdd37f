"""The functions of SQL."""

import pyarrow as pa

from spanfold.functions import sql
from spanfold.functions.sql import register_functions, search_function
from spanfold.sources.index import vectors


def test_functions(spark):
    register_functions(spark)
    docs = spark.createDataFrame([(1, "a x b"), (2, "b a"), (3, None), (4, ""), (5, "a x x x b")], "doc_id int, text string")
    held = vectors(docs)
    held.createOrReplaceTempView("held")
    rows = spark.sql(
        """SELECT doc_id, tsv_positions(tsv, 'a') AS p, tsv_within(tsv, 'a', 'b', 2) AS w, tsv_pre(tsv, 'a', 'b', 2) AS o, tsv_not_within(tsv, 'a', 'b', 2) AS l,
        tsv_match(tsv, '"b a" | a <~2> b') AS m, tsv_match(tsv, if(doc_id = 5, 'x & !z', NULL)) AS q FROM held ORDER BY doc_id"""
    ).collect()
    assert [tuple(r) for r in rows] == [
        (1, [1], True, True, False, True, None),
        (2, [2], True, False, False, True, None),
        (3, None, None, None, None, None, None),
        (4, [], False, False, False, False, None),
        (5, [1], False, False, True, False, True),
    ]
    search_function(spark, held, "close_by")
    assert sorted(r.doc_id for r in spark.sql("SELECT * FROM close_by('a', 'b', 2)").collect()) == [1, 2]
    assert spark.sql("SELECT count(*) AS n FROM held JOIN close_by('b', 'a', 4) USING (doc_id)").first().n == 3
    plan = spark.sql("SELECT * FROM close_by('a', 'b', 2)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Python") == held._jdf.queryExecution().executedPlan().toString().count("Python")  # none but that which makes the vectors


def test_vectors_become_objects_a_slice_at_a_time(monkeypatch):
    rows = [{"a": [1, 2], "b": [3]}, None, {}, {"c": [4]}, {"a": [5]}]
    tsv = pa.array([None if r is None else list(r.items()) for r in rows], pa.map_(pa.string(), pa.list_(pa.int32())))
    query = pa.array(["a <~1> b", "a", "!a", None, "b"])
    for most in (1, 3, 100):
        monkeypatch.setattr(sql, "SLICE_ITEMS", most)
        assert sql._matches(tsv, query).to_pylist() == [True, None, True, None, False]
        assert sql._matches(tsv.slice(2), query.slice(2)).to_pylist() == [True, None, False]
        assert sql._matches(tsv.slice(5), query.slice(5)).to_pylist() == []
