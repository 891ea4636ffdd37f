"""Search on a stream of texts, and an index that grows with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanfold.operators.search import Operand, recheck
from spanfold.sources.index import build_postings, to_vector


def matching(stream: DataFrame, query: str | Operand, source: str | None = None, text_col: str = "text") -> DataFrame:
    """Rows of a stream (or a table) whose text matches; stateless, row by row."""
    name = query.source if isinstance(query, Operand) else source
    held = stream.withColumn("__tsv", to_vector(text_col, name or "simple"))
    return held.where(recheck(query, source, "__tsv")).drop("__tsv")


def append_postings(stream: DataFrame, path: str, checkpoint: str, kind: str = "simple", id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Keep an index of all rows of a stream: each batch adds its postings in a folder of its own number, so that a batch that is done again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        postings = build_postings(batch, kind, id_col, text_col)
        postings.sortWithinPartitions("lexeme").write.mode("overwrite").parquet(f"{path}/batch={number}")

    step: Callable[[DataFrame, int], None] = add
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
