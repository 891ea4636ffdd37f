"""Concatenate and cut: all documents as one token stream, cut into windows of fixed length."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanfold.llm.common import list_parts, remove, spread, spread_out, written

VOCABULARY = os.environ.get("SPANFOLD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOS = 50_256
WINDOW = 2_048
#: Bytes of tokens that a partition of the sorted stream should hold.
PART_BYTES = 32 << 20
#: Rows of partition sums that are broadcast at most (16 bytes each).
MOST_BROADCAST = 1_000_000
#: Tokens of a run, the unit that is stored and cut.
RUN = 1 << 20
#: Bytes of text whose distinct words are encoded together.
SLICE_BYTES = 16 << 20


class Encoder:
    """Byte-level BPE of whole batches; the distinct space-separated words of a slice are encoded once, in one call."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leads = np.zeros(1 << 16, bool)
        self.leads[[n for token, n in ranks.items() if token.startswith(b" ")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint16)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint16 tokens of all rows and offsets by row.

        The splitting pattern always starts a new piece at a space before a character that is not white
        space, so a text whose spaces are all of that kind is encoded word by word. Others are encoded whole.
        Distinct words are encoded as one text: a token that begins with a space begins a word.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, r" (\s|$)|\pZ\pZ| [\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]")).to_numpy(zero_copy_only=False)
        offsets, flat = list_parts(pc.split_pattern(pc.if_else(pa.array(plain), texts, ""), " "))
        count = np.diff(offsets)
        first = np.zeros(len(flat), bool)
        first[offsets[:-1][count > 0]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        words = coded.dictionary
        made = [self.encode(w) for w in flat.filter(pa.array(first)).to_pylist()]
        inner = self.encode(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()) if len(words) else np.zeros(0, np.uint16)
        starts = np.flatnonzero(self.leads[inner])
        if len(starts) != len(words):
            raise ValueError("words and their tokens don't agree")
        begin, size = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        raw = coded.indices.to_numpy().astype(np.int64)
        begin[~first], size[~first] = starts[raw], np.diff(np.append(starts, len(inner)))[raw]
        lengths = np.array([len(m) for m in made], np.int64)
        begin[first], size[first] = len(inner) + np.cumsum(lengths) - lengths, lengths
        fast = np.concatenate([inner, *made])[spread(begin, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        if plain.all():
            return fast, ends
        whole = {int(i): self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(~plain)}
        parts = [whole[i] if i in whole else fast[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about `most` bytes, of a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop - at
        at = stop


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of uint16 values as binary."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def token_table(docs: DataFrame, vocabulary: str, eos: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n, tokens) of each document that has a token, with eos at its end; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for at, rows in slices(batch.column(2)):
                part = batch.slice(at, rows)
                tokens, offsets = encoder.batch(part.column(2))
                some = np.diff(offsets) > 0
                counts = np.diff(offsets)[some]
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                out = np.full(int(ends[-1]), eos, np.uint16)
                out[spread(ends[:-1], counts)] = tokens
                mask = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask), pa.array(counts + 1, pa.int32()), blobs(out, ends)], names=["doc_id", "text_hash", "n", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return written(spread_out(picked).mapInArrow(run, f"doc_id {kind}, text_hash long, n int, tokens binary"), "tokens")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each window: window_id, n_tokens, tokens, and its pieces doc_ids, doc_froms, piece_starts.

    Documents in order of id (null first), then of a hash of their text, are encoded, each followed by eos, and
    concatenated; window w holds tokens w * window to (w+1) * window - 1 of that stream, and only the last may be
    shorter. Piece k of a window is of document doc_ids[k], begins at its token doc_froms[k], and stands at
    piece_starts[k] in the window. Nothing is padded, dropped or repeated.

    Tokens are stored, then sorted by range and stored again as runs of documents with each run's offset in its
    partition; the sums of the partitions before it make that offset global (one sum a partition). Windows inside a
    run are cut where it lies; only those that cross a run's end are exchanged, as boundary records, and joined.

    Null and empty texts have no token and take no part. Equal rows follow one another, all kept. Very long
    texts fill as many windows as they need. No rows, or no text, give no rows. Other columns are not read.
    """
    if window < 1:
        raise ValueError("window must be 1 or more")
    if not 0 <= eos < 65_536:
        raise ValueError("tokens are kept in 16 bits")
    first = token_table(docs, vocabulary, eos, id_col, text_col)
    total = first.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes))
    kind = first.schema["doc_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            # runs of whole documents, a new one wherever the batch passes another RUN tokens
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends // RUN)) + 1, [len(n)]])
            for a, b in zip(cuts, cuts[1:]):
                tokens = b"".join(batch.column("tokens").slice(a, b - a).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c) for c in (batch.column("doc_id").slice(a, b - a), pa.array(n[a:b].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(a, 1), pa.array([seen]), pa.array([len(tokens) // 2]), *lists, pa.array([tokens], pa.binary())], names=["part", "start", "n", "doc_ids", "sizes", "tokens"])
                seen += len(tokens) // 2

    ranged = first.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").withColumn("part", F.spark_partition_id())
    stream = written(ranged.select("part", "doc_id", "n", "tokens").mapInArrow(number, f"part int, start long, n long, doc_ids array<{kind}>, sizes array<int>, tokens binary"), "stream")
    remove(first)

    totals = stream.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long").alias("before"))
    # a row a partition: the tokens are not to be exchanged for it while it is small
    placed = stream.join(F.broadcast(offsets) if parts <= MOST_BROADCAST else offsets, "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "sizes", "tokens")

    id_type = f"doc_ids array<{kind}>"
    schema = f"window_id long, at int, whole boolean, {id_type}, doc_froms array<bigint>, piece_starts array<int>, tokens array<int>"

    def cut(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, ids, sizes, tokens in zip(*(batch.column(c) for c in range(4))):
                    yield from cut_run(start.as_py(), ids.values, sizes.values.to_numpy(), np.frombuffer(tokens.as_buffer(), np.uint16), window, total, whole)

        return run

    complete = placed.mapInArrow(cut(True), schema)
    edges = placed.mapInArrow(cut(False), schema)
    ordered = F.array_sort(F.collect_list(F.struct("at", "doc_ids", "doc_froms", "piece_starts", "tokens")))
    joined = edges.groupBy("window_id").agg(ordered.alias("p"))
    joined = joined.select("window_id", *(F.flatten(F.col("p")[c]).alias(c) for c in ("doc_ids", "doc_froms", "piece_starts", "tokens")))
    columns = ["doc_ids", "doc_froms", "piece_starts", "tokens"]
    return complete.select("window_id", *columns).unionAll(joined.select("window_id", *columns)).select("window_id", F.size("tokens").alias("n_tokens"), "tokens", *columns[:3])


def cut_run(start: int, ids: pa.Array, sizes: np.ndarray, values: np.ndarray, window: int, total: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The windows inside a run of documents (whole), or the boundary records at its ends (not whole)."""
    base = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    end = start + len(values)
    edges = [start, *range((start // window + 1) * window, end, window), end]
    cuts = [(x, y) for x, y in zip(edges, edges[1:]) if (x % window == 0 and (y - x == window or y == total)) == whole]
    for k in range(0, len(cuts), 1_024):
        some = cuts[k : k + 1_024]
        x, y = np.array([c[0] for c in some]), np.array([c[1] for c in some])
        at, size = x - start, y - x
        first = np.searchsorted(base, at, side="right") - 1
        last = np.searchsorted(base, at + size, side="left") - 1
        count = last - first + 1
        doc = spread(first, count)
        owner = np.repeat(np.arange(len(x)), count)
        begin = np.maximum(base[doc], at[owner])
        piece_offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        token_offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        tokens = values[spread(at, size)].astype(np.int32)
        columns = [
            pa.array(x // window),
            pa.array((x % window).astype(np.int32)),
            pa.array(np.full(len(x), whole)),
            pa.ListArray.from_arrays(piece_offsets, ids.take(pa.array(doc))),
            pa.ListArray.from_arrays(piece_offsets, pa.array(begin - base[doc])),
            pa.ListArray.from_arrays(piece_offsets, pa.array((begin - at[owner] + x[owner] % window).astype(np.int32))),
            pa.ListArray.from_arrays(token_offsets, pa.array(tokens)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["window_id", "at", "whole", "doc_ids", "doc_froms", "piece_starts", "tokens"])
