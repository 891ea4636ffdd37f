"""The search as functions of SQL: register_functions(spark), then SELECT ... WHERE tsv_match(tsv, 'a <~3> b')."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.operators.exprs import LAST, Sql
from spanfold.operators.search import compiled
from spanfold.plans import evaluate
from spanfold.sources.index import slices

_TSV = "MAP<STRING, ARRAY<INT>>"


#: Lexemes and positions of vectors that are Python's objects at a time.
SLICE_ITEMS = 50_000


def _matches(tsv: pa.Array, query: pa.Array) -> pa.Array:
    """Whether each vector matches its query, by the plain evaluator; null where either is null."""
    out = []
    ends = tsv.offsets.to_numpy()
    items = np.diff(ends) + np.diff(tsv.items.offsets.to_numpy()[ends])
    for start, length in slices(items, SLICE_ITEMS):
        for vector, text in zip(tsv.slice(start, length).to_pylist(maps_as_pydicts="strict"), query.slice(start, length).to_pylist()):
            if vector is None or text is None:
                out.append(None)
                continue
            c = compiled(text)
            out.append(evaluate.matches(c.tree, lambda leaf, c=c, vector=vector: evaluate.leaf_positions(vector, c.found[leaf].kind, c.found[leaf].values)))
    return pa.array(out, pa.bool_())


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL.

    tsv_positions, tsv_within, tsv_pre, tsv_not_within are SQL themselves, so Catalyst inlines them and they run in the JVM; tsv_match takes any
    query, also one that differs by row, and runs on Arrow batches. Where the query is one constant, recheck() and search() run in the JVM.
    """

    @F.arrow_udf("boolean")
    def tsv_match(tsv: pa.Array, query: pa.Array) -> pa.Array:
        return _matches(tsv, query)

    spark.udf.register("tsv_match", tsv_match)

    def define(name: str, parameters: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    def of(word: str) -> str:
        return f"coalesce(tsv[{word}], cast(array() AS array<int>))"

    pair = f"tsv {_TSV}, a STRING, b STRING, n INT"
    define("tsv_positions", f"tsv {_TSV}, a STRING", "ARRAY<INT>", f"if(tsv IS NULL, NULL, {of('a')})")
    near = Sql(str)
    define("tsv_within", pair, "BOOLEAN", f"if(tsv IS NULL, NULL, {near.within(of('a'), of('b'), 'n', False)})")
    define("tsv_pre", pair, "BOOLEAN", f"if(tsv IS NULL, NULL, {near.within(of('a'), of('b'), 'n', True)})")
    lone = f"size({of('a')}) > 0 AND (array_contains({of('b')}, {LAST}) OR exists({of('a')}, x -> NOT exists({of('b')}, y -> abs(x - y) <= n)))"
    define("tsv_not_within", pair, "BOOLEAN", f"if(tsv IS NULL, NULL, {lone})")


def search_function(spark: SparkSession, vectors: DataFrame, name: str, id_col: str = "doc_id", tsv: str = "tsv") -> None:
    """A table function of SQL over a table of vectors: SELECT * FROM name('a', 'b', 3) gives the ids where the words stand that near. Catalyst inlines it."""
    register_functions(spark)
    vectors.createOrReplaceTempView(f"{name}_vectors")
    kind = vectors.schema[id_col].dataType.simpleString()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING, n INT) RETURNS TABLE (`{id_col}` {kind}) RETURN SELECT v.`{id_col}` FROM {name}_vectors AS v WHERE tsv_within(v.`{tsv}`, {name}.a, {name}.b, {name}.n)")
