"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.llm import ann, chat, decontaminate, html, licenses, packing, quality, sharding, simhash, warc

SHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), SHARDS, seed=7)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_warc(table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, searched among all rows."""
    found = ann.neighbours(table(spark, sf_dir, "embeddings"), asked="vec_id % 20 = 0")
    return found.withColumn("distance", F.round("distance", 6))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded from a log with streams, edits, regenerations, deletions and repeated deliveries."""
    return chat.reconstruct(chat.turns_to_events(table(spark, sf_dir, "conversations"), revised=True))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", "quality_score", "quality_keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
}

#: op6 has the exact neighbours here. The search gives the same on tables of up to 1,024 rows, whose few leaves are all read;
#: on larger ones it is approximate, and tests/llm/test_ann.py measures its recall.
ORACLE_SQL: dict[str, str] = {
    "op6_nearest_neighbours": f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id, b.vec_id AS neighbour_id, list_distance(q.e, b.e) AS far FROM v q JOIN v b ON b.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY far, neighbour_id) AS INTEGER) AS rank, neighbour_id, round(far, 6) AS distance
FROM d QUALIFY rank <= {ann.NEIGHBOURS}""",
    "op2_sharding": f"""
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', doc_id))) AS rank, count(*) OVER (PARTITION BY source) AS size
  FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * size), source) - 1 AS shard_pos, count(*) OVER () AS total FROM r)
SELECT doc_id, text, lang, source, n_chars, CAST(shard_pos * {SHARDS} // total AS INTEGER) AS shard, shard_pos FROM p""",
    "op7_chat_formatting": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, md5(coalesce(length(role)::VARCHAR || '=' || role, '-') || '|' || text)) AS rendered
FROM t GROUP BY conv_id""",
}
