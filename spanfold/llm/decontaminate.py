"""Benchmark decontamination with a stored positional inverted index of the documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanfold.llm.common import remove, spread_out, tokenize, written

#: Tokens of a phrase that counts as a leak (a shorter test item counts as a whole).
PHRASE = 10
#: Tokens more than its own length over which the terms of a stretch of a test item may be spread.
SLOP = 5
#: Share of an item's stretches that must be found near one another's place for a proximity match.
SHARE = 0.8
#: Tokens that a test item must have for its documents to be dropped: a word or two stand in clean documents too.
LEAST = 5
#: Characters of test items that are searched for at once.
ITEM_CHARS = 4_000_000
#: Positions left free between documents, more than any window.
GAP = 1 << 10
_POSTINGS = "segment string, term string, n int, postings binary"


def item_tokens(texts: list[str | None]) -> list[list[str]]:
    codes, vocabulary, offsets = tokenize(pa.array(texts, pa.string()))
    return [[vocabulary[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored index: postings (segment, term, n, postings) and documents (segment, ids, starts).

    Each batch of documents makes a segment with its own positions: its documents follow one another with
    GAP free positions between them. The postings of a term are its ascending positions, as uint32 differences.
    All terms of all texts are stored; building is one narrow pass, and no posting is sent over the network.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 16_384
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                codes, vocabulary, offsets = tokenize(part.column(1))
                counts = np.diff(offsets)
                if int(offsets[-1]) + GAP * len(counts) >= 2**32:
                    raise ValueError("a batch holds too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
                segment = uuid4().hex
                lead = np.arange(len(counts), dtype=np.int64) * GAP
                positions = np.arange(len(codes), dtype=np.int64) + np.repeat(lead, counts)
                order = np.argsort(codes.astype(np.uint32), kind="stable")
                sizes = np.bincount(codes, minlength=len(vocabulary))
                sorted_positions = positions[order]
                deltas = np.diff(sorted_positions, prepend=0)
                firsts = np.cumsum(sizes) - sizes
                deltas[firsts] = sorted_positions[firsts]
                values = deltas.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(vocabulary), [None, pa.py_buffer(ends), pa.py_buffer(values)])
                rows = len(vocabulary)
                nothing = [pa.nulls(rows, pa.list_(part.column(0).type)), pa.nulls(rows, pa.list_(pa.int64()))]
                names = ["segment", "term", "n", "postings", "ids", "starts"]
                yield pa.RecordBatch.from_arrays([pa.array([segment] * rows, pa.string()), pa.array(vocabulary, pa.string()), pa.array(sizes, pa.int32()), blobs, *nothing], names=names)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in (part.column(0), pa.array(offsets[:-1] + lead, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *lists], names=names)

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stored = written(spread_out(picked).mapInArrow(run, f"{_POSTINGS}, ids array<{kind}>, starts array<bigint>"), "postings")
    return stored.where("term is not null").select("segment", "term", "n", "postings"), stored.where("term is null").select("segment", "ids", "starts")


def held(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of wanted are among sorted_values."""
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    return (at < len(sorted_values)) & (sorted_values[np.minimum(at, len(sorted_values) - 1)] == wanted)


_NONE = np.zeros(0, np.int64)


def phrase_runs(item: list[str], lists: dict[str, np.ndarray], seen: dict[str, int], size: int) -> list[tuple[int, int, int]]:
    """(position, item offset, tokens) of the longest runs of at least `size` tokens that text and item share.

    For each window of the item the postings of its rarest term, less its offset, are intersected with those of its
    other terms, in order of rarity, until none is left.
    """
    rarity = [seen.get(t, 0) for t in item]
    hits = []
    for j in range(len(item) - size + 1):
        window = sorted(range(j, j + size), key=lambda i: (rarity[i], i))
        if not rarity[window[0]]:
            continue
        starts = lists.get(item[window[0]], _NONE) - window[0]
        for i in window[1:]:
            if not len(starts):
                break
            starts = starts[held(lists.get(item[i], _NONE), starts + i)]
        if len(starts):
            hits.append(np.stack([starts, np.full(len(starts), j)], 1))
    if not hits:
        return []
    both = np.concatenate(hits)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:, 0] != both[:-1, 0]) | (both[1:, 1] != both[:-1, 1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(both)) - 1
    return [(int(both[a, 0] + both[a, 1]), int(both[a, 1]), int(both[b, 1] - both[a, 1] + size)) for a, b in zip(first, last)]


def near_terms(terms: list[str], lists: dict[str, np.ndarray], seen: dict[str, int], span: int) -> list[int]:
    """Positions p of the rarest term such that some `span` tokens that hold p hold all the terms."""
    if any(t not in lists for t in terms):
        return []
    order = sorted(set(terms), key=lambda t: (seen.get(t, 0), t))
    at = lists[order[0]]
    for t in order[1:]:
        at = at[np.searchsorted(lists[t], at + span) > np.searchsorted(lists[t], at - span + 1)]
    good = np.zeros(len(at), bool)
    for low in range(1 - span, 1):  # where the tokens begin, from p on
        fits = np.ones(len(at), bool)
        for t in order:
            fits &= np.searchsorted(lists[t], at + low + span) > np.searchsorted(lists[t], at + low)
            if not fits.any():
                break
        good |= fits
    return at[good].tolist()


def stretches(item: list[str], size: int) -> list[list[str]]:
    """The item cut into pieces of `size` tokens, the last one counted from its end."""
    return [item[min(a, len(item) - size) :][:size] for a in range(0, len(item), size)]


def matches(items: list[tuple[int, list[str]]], lists: dict[str, np.ndarray], seen: dict[str, int], phrase: int, slop: int, share: float, starts: Sequence[int] = (), least: int = 1) -> Iterator[tuple[int, str, int, int, int]]:
    """(item number, kind, position, item offset, tokens) in the positions of one segment, whose documents begin at starts."""
    for number, tokens in items:
        if len(tokens) < max(1, least):
            continue
        size = min(phrase, len(tokens))
        for position, offset, length in phrase_runs(tokens, lists, seen, size):
            yield number, "phrase", position, offset, length
        parts = stretches(tokens, size)
        found: list[tuple[int, int]] = []
        for k, part in enumerate(parts):
            found += [(p, k) for p in near_terms(part, lists, seen, size + slop)]
        need = max(1, -(-int(share * 1000) * len(parts) // 1000))
        found.sort()
        reach = len(tokens) + slop * len(parts)
        last = None
        for n, (p, _) in enumerate(found):
            if last is not None and p <= last:
                continue
            following = bisect_right(starts, p)  # a passage ends with its document at the latest
            end = min(p + reach, starts[following]) if following < len(starts) else p + reach
            inside = found[n : bisect_left(found, (end, -1))]
            if len({k for _, k in inside}) >= need:
                last = inside[-1][0]
                yield number, "proximity", p, -1, last - p + 1


def leaks(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, slop: int = SLOP, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS, least: int = 1) -> DataFrame:
    """One row for each match: doc_id, item_id, kind, start, item_start, tokens.

    kind 'phrase': a longest run of at least `phrase` tokens (the whole item if it is shorter) that stands word
    for word in both; start and item_start are its token offsets in the document and the item, tokens its
    length. kind 'proximity': the item is cut into stretches of `phrase` tokens; at least `share` of them
    have all their terms, in any order, within their length plus `slop` tokens, close enough together to be one
    passage; start is the first rarest term's offset, item_start -1, and tokens the extent to the last one. Words are compared in
    lower case without punctuation.

    The index of all documents is built and stored first (see build_index). The test terms pick their postings; those
    of a segment come together, and lists are intersected from the term that is rarest over all documents. Only
    postings of test terms are exchanged. Items are read and searched for in portions of at most item_chars characters (or of one item), so what
    the driver and each task hold is bounded; where there are several, each portion's matches are written before the next is read.

    Null or empty texts and items match nothing, nor do items of fewer than `least` tokens. A null id is reported as null. Repeated documents and
    repeated items are each reported. Texts are read whole. Other columns are not read. No rows give no rows.
    """
    postings, documents = build_index(docs, id_col, text_col)
    return search(postings, documents, benchmark, phrase, slop, share, item_col, item_text_col, item_chars, least)


def search(postings: DataFrame, documents: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, slop: int = SLOP, share: float = SHARE, item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS, least: int = 1) -> DataFrame:
    """leaks() over an index that is stored already."""
    if phrase + slop >= GAP:
        raise ValueError(f"phrase and slop together must stay under {GAP}")
    spark = postings.sparkSession
    kind = documents.schema["ids"].dataType.elementType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, kind string, start long, item_start int, tokens int"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    found: list[DataFrame] = []

    def searched(rows: list[tuple]) -> DataFrame:
        return _portion(spark, postings, documents, rows, phrase, slop, share, schema, item_type, least)

    portion: list[tuple] = []
    chars = 0
    for row in benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("t is not null").toLocalIterator():
        if chars + len(row.t) > item_chars and portion:
            found.append(written(searched(portion), "matches"))
            portion, chars = [], 0
        portion.append((row.i, row.t))
        chars += len(row.t)
    return reduce(DataFrame.unionAll, [*found, searched(portion)])


def _portion(spark, postings: DataFrame, documents: DataFrame, rows: list[tuple], phrase: int, slop: int, share: float, schema: str, item_type: pa.DataType, least: int) -> DataFrame:
    tokens = item_tokens([t for _, t in rows])
    terms = sorted({t for item in tokens for t in item})
    wanted = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": pd.Series(terms, dtype="str")}), "term string"))  # at most item_chars characters
    picked = postings.join(wanted, "term")
    seen = {r.term: r.n for r in picked.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    sent = spark.sparkContext.broadcast((list(enumerate(tokens)), seen, pa.array([i for i, _ in rows], item_type), phrase, slop, share, least))

    def run(key: tuple, hits: pa.Table, docs: pa.Table) -> pa.Table:
        items, counts, item_ids, phrase, slop, share, least = sent.value
        lists = {t: np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)) for t, p in zip(hits.column("term").to_pylist(), hits.column("postings").to_pylist())}
        doc_ids, starts = docs.column("ids").combine_chunks().flatten(), docs.column("starts").combine_chunks().flatten().to_numpy()
        found = list(matches(items, lists, counts, phrase, slop, share, starts.tolist(), least))
        number, name, position, offset, length = map(list, zip(*found)) if found else ([], [], [], [], [])
        at = np.asarray(position, np.int64)
        doc = np.searchsorted(starts, at, side="right") - 1
        columns = [
            doc_ids.take(pa.array(doc, pa.int64())),
            item_ids.take(pa.array(number, pa.int64())),
            pa.array(name, pa.string()),
            pa.array(at - starts[doc], pa.int64()),
            pa.array(offset, pa.int32()),
            pa.array(length, pa.int32()),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "item_id", "kind", "start", "item_start", "tokens"])

    return picked.select("segment", "term", "postings").groupBy("segment").cogroup(documents.toDF("of_segment", "ids", "starts").groupBy("of_segment")).applyInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE, slop: int = SLOP, share: float = SHARE, item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS, least: int = LEAST) -> DataFrame:
    """docs without those that leaks() reports for items of at least `least` tokens; rows count as one document if they agree in id and text.

    Rows without a match all stay, also null and empty texts. Columns may have any names and pass through. The index is deleted when the matches are known.
    """
    text = F.col(f"`{text_col}`").cast("string")
    key = F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))
    postings, documents = build_index(docs.select(key.alias("key"), text.alias("text")), "key", "text")
    bad = written(search(postings, documents, benchmark, phrase, slop, share, item_col, item_text_col, item_chars, least).select(F.col("doc_id").alias("key")).distinct(), "leaks")
    remove(postings)
    # the columns of docs stay in one struct, so that no name of theirs can meet one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
