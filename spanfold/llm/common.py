"""What the operators of this subpackage share: tables in the shared folder, columns, and tokens."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.storage import remove, written

WORD = re.compile(r"\w+")


def with_columns(df: DataFrame, new: dict) -> DataFrame:
    """Add columns; a column of the same name that df has already is replaced (names ignore case)."""
    low = {c.lower() for c in new}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in low), *(v.alias(k) for k, v in new.items()))


def spread_out(df: DataFrame, least_rows: int = 1_000) -> DataFrame:
    """df over all cores, where its few files would leave most of them idle: a row group is read by one task, whatever comes after it.

    Tables of more files than tasks can run at once pass as they are; of others the rows of each partition are counted first, which reads no column.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < tasks:
        return df
    counts = [r["count"] for r in df.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect()]  # a row a partition, of fewer files than tasks
    return df.repartition(tasks) if sum(counts) >= least_rows and 2 * len(counts) < tasks else df


def list_parts(arr: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and flat values of a list array, sliced or not."""
    offsets = arr.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], arr.values.slice(offsets[0], offsets[-1] - offsets[0])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def tokenize(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-case word tokens of a batch: codes into a vocabulary, the vocabulary, and offsets by row.

    Words are maximal runs of letters, digits and underscores; null has no tokens.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    offsets, flat = list_parts(pc.utf8_split_whitespace(low))
    if not len(flat):
        return np.zeros(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
    coded = flat.dictionary_encode()
    chunks, raw = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    vocabulary: dict[str, int] = {}
    words, sizes = [], np.empty(len(chunks), np.int64)
    for i, chunk in enumerate(chunks):
        parts = (chunk,) if chunk.isalnum() else WORD.findall(chunk)
        sizes[i] = len(parts)
        for w in parts:
            words.append(vocabulary.setdefault(w, len(vocabulary)))
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[raw]
    codes = np.asarray(words, np.int64)[spread(starts[raw], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return codes, list(vocabulary), ends[offsets]


__all__ = ["WORD", "list_parts", "remove", "spread", "spread_out", "tokenize", "with_columns", "written"]
