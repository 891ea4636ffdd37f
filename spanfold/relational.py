"""What goes around a search: counts under a condition, ordered aggregates, windows, quantiles, lateral joins and made-up corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanfold.functions.sql import register_functions, search_function
from spanfold.operators.search import search_postings
from spanfold.plans.select import query_native
from spanfold.queries import DSL, Query, bare, documents, index, sql, stored_vectors

#: Words from which the made-up corpus is drawn, and its size.
SERIES_DOCS, SERIES_WORDS = 2_000, 40
TOPICS = 16


def wrap_srf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as a table function of SQL."""
    search_function(spark, stored_vectors(spark, sf_dir), "near_words")
    return spark.sql("SELECT doc_id FROM near_words('the', 'of', 3)")


def op_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator form in SQL: a vector against a query's text."""
    register_functions(spark)
    stored_vectors(spark, sf_dir).createOrReplaceTempView("op_match_vectors")
    return spark.sql("SELECT doc_id FROM op_match_vectors WHERE tsv_match(tsv, '*cense')")


def native_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exactly equivalent native form, run in place of the query."""
    return search_postings(index(spark, sf_dir), query_native(DSL["op_within"][0]))


def all_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each lexeme of each vector."""
    return stored_vectors(spark, sf_dir).select("doc_id", F.explode(F.map_keys("tsv")).alias("lexeme"))


def count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: documents, and those that match, counted in one pass."""
    found = search_postings(index(spark, sf_dir), DSL["op_within"][0]).withColumn("hit", F.lit(True))
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return langs.join(found, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if("hit").alias("matching"))


def ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each document as text, its lexemes in order."""
    entry = F.concat("lexeme", F.lit(":"), F.size("positions"))
    return index(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lexeme", entry.alias("entry")))), lambda e: e["entry"]), " ").alias("tsv_text"))


def cdf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the documents up to each class of sizes; a row for each class enters the window."""
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.expr("n_chars div 500").alias("size_class")).agg(F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy("size_class")
    upto = F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.select("size_class", "docs", F.round(upto / F.sum("docs").over(Window.partitionBy()), 9).alias("cdf"))


def lag_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the role before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


def percentile_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of sizes by source, from counts of equal sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source", "n_chars").count()
    return docs.groupBy("source").agg(*(F.round(F.expr(f"percentile(n_chars, {p}, count)"), 6).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"))))


def lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of a few terms its documents, by a lateral join."""
    index(spark, sf_dir).createOrReplaceTempView("lateral_postings")
    return spark.sql("SELECT t.term, p.doc_id, p.n FROM VALUES ('license'), ('apache'), ('zyx') AS t(term), LATERAL (SELECT doc_id, size(positions) AS n FROM lateral_postings WHERE lexeme = t.term) AS p")


def generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made up from a series of numbers."""
    words = F.transform(F.sequence(F.lit(1), F.lit(SERIES_WORDS)), lambda j: F.concat(F.lit("w"), (F.col("doc_id") * 7 + j * j * 13 + F.col("doc_id") * j) % 101))
    return spark.range(1, SERIES_DOCS + 1).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(words, " ").alias("text"))


def hash_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic for each document, by arithmetic on its id."""
    return documents(spark, sf_dir).select("doc_id", (F.expr("(doc_id * 2654435761) % 4294967296") % TOPICS).cast("int").alias("topic"))


QUERIES: dict[str, Query] = {
    "wrap_srf": wrap_srf,
    "op_match": op_match,
    "native_query": native_query,
    "all_lexemes": all_lexemes,
    "rel_count_filter": count_filter,
    "rel_string_agg": ordered_string_agg,
    "rel_cdf_window": cdf_window,
    "rel_lag": lag_window,
    "rel_percentile_cont": percentile_cont,
    "rel_lateral": lateral,
    "rel_generate_series": generate_series,
    "rel_hash_topics": hash_topics,
}

ORACLE_SQL: dict[str, str] = {
    "wrap_srf": DSL["op_within"][1],
    "op_match": DSL["op_suffix"][1],
    "native_query": DSL["op_within"][1],
    "all_lexemes": sql("SELECT DISTINCT doc_id, lexeme FROM p"),
    "rel_count_filter": sql(f"SELECT lang, count(*) AS docs, count(*) FILTER (WHERE doc_id IN ({bare(DSL['op_within'][1])})) AS matching FROM documents GROUP BY lang"),
    "rel_string_agg": sql("SELECT doc_id, string_agg(lexeme || ':' || n, ' ' ORDER BY lexeme) AS tsv_text FROM (SELECT doc_id, lexeme, count(*) AS n FROM p GROUP BY doc_id, lexeme) GROUP BY doc_id"),
    "rel_cdf_window": "SELECT size_class, docs, round(sum(docs) OVER (ORDER BY size_class)::DOUBLE / sum(docs) OVER (), 9) AS cdf FROM (SELECT n_chars // 500 AS size_class, count(*) AS docs FROM documents GROUP BY ALL)",
    "rel_lag": "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations",
    "rel_percentile_cont": "SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY source",
    "rel_lateral": sql("SELECT t.term, q.doc_id, q.n FROM (VALUES ('license'), ('apache'), ('zyx')) AS t(term), LATERAL (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM p WHERE p.lexeme = t.term GROUP BY doc_id) AS q"),
    "rel_generate_series": f"SELECT d AS doc_id, string_agg('w' || ((d * 7 + j * j * 13 + d * j) % 101), ' ' ORDER BY j) AS text FROM generate_series(1, {SERIES_DOCS}) AS a(d), generate_series(1, {SERIES_WORDS}) AS b(j) GROUP BY d",
    "rel_hash_topics": f"SELECT doc_id, CAST((doc_id * 2654435761) % 4294967296 % {TOPICS} AS INTEGER) AS topic FROM documents",
}
