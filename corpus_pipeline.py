"""From documents to packed training windows: stages that each work on all that the one before kept.

Every stage but the last returns the columns of its documents, in their order, whatever other columns there are and whatever their names. Null ids and repeated
rows are rows like others. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanfold.llm import decontaminate, packing, quality, simhash
from spanfold.llm.common import remove, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labelled documents among them.

    Null texts and texts of white space alone have no content and go. Whole texts are scored, however long; a score that ties with the threshold keeps its
    document, and equal texts score alike. Where the labels lack a class, every document with content stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.select(quality.nested(docs), "text"), model).where("quality_keep").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, null ids last.

    Of rows equal in id and text one stays. Texts without a word are duplicates if they are equal; null and blank ones all stay. Texts are read whole.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts match nothing and stay; rows that agree in id and text stay or go together. Texts and items are read whole; items of fewer than
    decontaminate.LEAST tokens drop nothing.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens of all that is left, documents in order of id, null first, then of a hash of their text.

    Null and empty texts have no token. Equal rows follow one another, all packed. A long text fills as many windows as it needs.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: No stage of these can be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each one's result written as Parquet and read again; what the stage after it has read is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, f"stage{number}")
            if before is not None:
                remove(before)
            before = docs
    return docs
