"""Document vectors and the postings index, built from texts and kept as Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.functions.text import LAST_POSITION, LONGEST, MOST_POSITIONS, PLAIN, Analyzer, TextConfig, source
from spanfold.plans.resolve import dictionary_words
from spanfold.storage import exists

VECTOR = "map<string,array<int>>"
_ENTRIES = "array<struct<lexeme:string,positions:array<int>>>"


def plain_tokens(text: str) -> Column:
    """Words of a text column in order, in the JVM: lower case, a hyphenated word before its parts."""
    found = F.expr(f"regexp_extract_all(lower({text}), '{PLAIN.replace(chr(92), chr(92) * 2)}', 0)")
    parts = F.transform(found, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t)))
    return F.when(F.contains(F.col(text), F.lit("-")), F.flatten(parts)).otherwise(found)


Tokens = tuple[pa.Array, np.ndarray, np.ndarray, int]  # lexemes, their positions and rows, and how many rows there are

#: Bytes of texts that are read at a time: Spark's batches have as many rows however long these are, and tokens take a hundred times their letters' room.
SLICE_BYTES = 1 << 20
#: Different stretches of text whose tokens are remembered, and the longest of them.
MOST_KNOWN, LONGEST_KNOWN = 50_000, 64


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of ranges of whole rows, each of about that size; none has more than one row beyond it."""
    at = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    yield from zip(starts.tolist(), np.diff(np.append(starts, len(sizes))).tolist())


def _sizes(brought: pa.Array) -> np.ndarray:
    """Bytes of each row's text or words."""
    if pa.types.is_list(brought.type):
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(brought.values).to_numpy(zero_copy_only=False))])
        return np.diff(ends[brought.offsets.to_numpy()])
    return pc.fill_null(pc.binary_length(brought), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def grouped(lexemes: pa.Array, positions: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """Row, lexeme and ascending positions of each lexeme of each row, in order of rows, within the limits of a vector."""
    coded = lexemes if isinstance(lexemes, pa.DictionaryArray) else lexemes.dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    fits = pc.less_equal(pc.binary_length(names), LONGEST).to_numpy(zero_copy_only=False)
    if not fits.all():
        kept = fits[code]
        code, positions, row = code[kept], positions[kept], row[kept]
    # one number for row, lexeme and position: sorted once, without repetitions
    places = LAST_POSITION + 1
    keys = np.sort((row * len(names) + code) * places + np.minimum(positions, LAST_POSITION))
    owner, p = np.divmod(keys[np.diff(keys, prepend=-1) != 0], places)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    r, c = np.divmod(owner[starts], max(1, len(names)))
    sizes = np.diff(np.append(starts, len(owner)))
    kept = np.arange(len(owner)) - np.repeat(starts, sizes) < MOST_POSITIONS
    sizes = np.minimum(sizes, MOST_POSITIONS)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(p[kept].astype(np.int32)))
    return r, names.take(pa.array(c)), lists


def _as_entries(tokens: Tokens) -> pa.ListArray:
    """One list a row of its lexemes, each with its positions."""
    row, lexemes, lists = grouped(*tokens)
    entries = pa.StructArray.from_arrays([lexemes, lists], names=["lexeme", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=tokens[3]))]), pa.int32()), entries)


def _reader(kind: str | TextConfig | Analyzer, text: str) -> tuple[Column, Callable[[pa.Array], Tokens]]:
    """What a batch is to bring of a text column, and how it is read."""
    reader = source(kind) if isinstance(kind, str) else kind

    def of_words(tokens: pa.Array) -> Tokens:
        """Words that the JVM has found, in order."""
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        flat = tokens.values.slice(offsets[0], offsets[-1] - offsets[0])
        counts = np.diff(offsets)
        row = np.repeat(np.arange(len(counts)), counts)
        return flat, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], counts) + 1, row, len(counts)

    known: dict[str, tuple[list[tuple[str, int]], int]] = {}

    def cut(stretch: str) -> tuple[list[tuple[str, int]], int]:
        found = known.get(stretch)
        if found is None:
            found = reader.cut(stretch)
            if len(stretch) <= LONGEST_KNOWN:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                known[stretch] = found
        return found

    def of_stretches(texts: pa.Array) -> Tokens:
        """Texts of which each different stretch is analyzed once."""
        codes: dict[str, int] = {}
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            if text:
                parts = reader.stretches(text)
                counts[i] = len(parts)
                flat += [codes.setdefault(s, len(codes)) for s in parts]
        made = [cut(s) for s in codes]
        words = pa.array([x for tokens, _ in made for x, _ in tokens], pa.string()).dictionary_encode()
        inner = np.array([p for tokens, _ in made for _, p in tokens], np.int64)
        sizes, taken, which = np.array([len(tokens) for tokens, _ in made], np.int64), np.array([n for _, n in made], np.int64), np.array(flat, np.int64)
        before = np.concatenate([[0], np.cumsum(taken[which])])
        base = before[:-1] - np.repeat(before[np.cumsum(counts) - counts], counts)
        each, ends = sizes[which], np.cumsum(sizes[which])
        token = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each) + np.arange(each.sum())
        lexemes = pa.DictionaryArray.from_arrays(words.indices.take(pa.array(token)), words.dictionary)
        return lexemes, inner[token] + np.repeat(base, each), np.repeat(np.repeat(np.arange(len(texts)), counts), each), len(texts)

    def of_texts(texts: pa.Array) -> Tokens:
        found = [reader.tokens(t) if t else [] for t in texts.to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = [x for f in found for x in f]
        return pa.array([x for x, _ in flat], pa.string()), np.array([p for _, p in flat], np.int64), row, len(found)

    if isinstance(reader, TextConfig) and reader.filter is None and reader.dictionary is None:
        return F.coalesce(plain_tokens(text), F.array().cast("array<string>")), of_words
    return F.col(text), of_stretches if isinstance(reader, Analyzer) else of_texts


def _entries(kind: str | TextConfig | Analyzer, text: str) -> Column:
    """Entries of a vector of a text column, null for a null text."""
    brought, read = _reader(kind, text)

    @F.arrow_udf(_ENTRIES)
    def group(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, length in slices(_sizes(batch), SLICE_BYTES):
                yield _as_entries(read(batch.slice(start, length)))

    return F.when(F.col(text).isNotNull(), group(brought))


def to_vector(text: str = "text", kind: str | TextConfig | Analyzer = "simple") -> Column:
    """The vector of a text column: lexemes with their positions."""
    return F.map_from_entries(_entries(kind, text))


def vectors(docs: DataFrame, kind: str | TextConfig | Analyzer = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tsv): one narrow pass over the texts."""
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).select(id_col, to_vector("text", kind).alias("tsv"))


def unnest(vectors: DataFrame, id_col: str = "doc_id", tsv: str = "tsv") -> DataFrame:
    """(id, lexeme, positions): a row for each lexeme of each vector.

    explode() alone would have Spark filter by the vector's size first, and so make vectors that aren't stored twice.
    """
    return vectors.select(F.col(id_col), F.explode_outer(tsv).alias("lexeme", "positions")).where("lexeme IS NOT NULL")


def build_postings(docs: DataFrame, kind: str | TextConfig | Analyzer = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lexeme, positions) straight from texts: one narrow pass, no exchange. Null texts have none."""
    brought, read = _reader(kind, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, brought = batch.columns
            for start, length in slices(_sizes(brought), SLICE_BYTES):
                row, lexemes, lists = grouped(*read(brought.slice(start, length)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + start)), lexemes, lists], names=[id_col, "lexeme", "positions"])

    made = docs.select(F.col(id_col), F.col(text_col).alias("text")).where("text is not null").select(id_col, brought.alias("brought"))
    return made.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lexeme string, positions array<int>")


# --- the stored index

#: Bytes of input files for which an index gets another bucket: few enough for a task to sort their postings, some 17 times as many bytes, in memory.
BUCKET_BYTES = 16 << 20


def _buckets(docs: DataFrame, buckets: int | None) -> int:
    """How many buckets an index of these texts gets: one a shuffle partition, and one for BUCKET_BYTES of the tables that they come from at least."""
    if buckets:
        return buckets
    tables = docs._jdf.queryExecution().optimizedPlan().collectLeaves()  # Spark takes the columns that are read for a share of these, by their types alone
    sizes = [int(str(tables.apply(i).stats().sizeInBytes())) for i in range(tables.size())]
    known = sum(size for size in sizes if size < 1 << 60)  # a table that is no file has the largest number for its size
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // BUCKET_BYTES), 100_000))


def _write_bucketed(df: DataFrame, path: str, id_col: str, buckets: int, sort: list[str]) -> None:
    """df, which is exchanged by id into so many buckets already, as files of one bucket each."""
    name = _table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    write = df.write.format("parquet").mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#lexeme", "true" if "lexeme" in sort else "false")
    write.bucketBy(buckets, id_col).sortBy(*sort).option("path", path).saveAsTable(name)


def _table_name(path: str) -> str:
    return "spanfold_" + hashlib.md5(path.encode()).hexdigest()


def _read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """Files of buckets as a table that Spark knows to be bucketed: grouping and joining by id need no exchange."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        about = json.loads(spark.read.text(f"{path}.json", wholetext=True).first()[0])
        spark.sql(f"CREATE TABLE {name} ({about['columns']}) USING parquet CLUSTERED BY (`{about['id']}`) SORTED BY ({', '.join(about['sort'])}) INTO {about['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _describe(spark: SparkSession, path: str, df: DataFrame, id_col: str, buckets: int, sort: list[str]) -> None:
    """What _read_bucketed() needs in another session, beside the files."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    text = json.dumps({"columns": columns, "id": id_col, "buckets": buckets, "sort": sort})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")


def _store(df: DataFrame, path: str, id_col: str, buckets: int, sort: list[str]) -> None:
    _write_bucketed(df.sortWithinPartitions(*sort), path, id_col, buckets, sort)
    _describe(df.sparkSession, path, df, id_col, buckets, sort)


def write_index(docs: DataFrame, path: str, kind: str | TextConfig | Analyzer = "simple", buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the index of texts in folders of path: postings, and the ids of all documents that have a text.

    Texts, which are smaller than their postings, are exchanged once, by document. Each bucket then holds all postings of its documents, sorted by lexeme,
    so a query's conditions skip row groups and pages of each bucket and no posting is ever exchanged again, not even one of a word that most documents have.
    """
    n = _buckets(docs, buckets)
    sent = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).repartition(n, F.col(id_col))
    _store(build_postings(sent, kind, id_col, text_col), f"{path}/postings", id_col, n, ["lexeme", id_col])
    _store(docs.where(F.col(text_col).isNotNull()).select(id_col).repartition(n, F.col(id_col)), f"{path}/ids", id_col, n, [id_col])


def write_postings(postings: DataFrame, path: str, buckets: int | None = None, id_col: str = "doc_id") -> None:
    """Store postings that come from elsewhere as an index; they are exchanged once, by document. Documents without a posting are not known to it."""
    n = buckets or int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _store(postings.select(id_col, "lexeme", "positions").repartition(n, F.col(id_col)), f"{path}/postings", id_col, n, ["lexeme", id_col])
    _store(_read_bucketed(postings.sparkSession, f"{path}/postings").select(id_col).distinct(), f"{path}/ids", id_col, n, [id_col])


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(id, lexeme, positions) of a stored index, or of one that a stream appends to."""
    return _read_bucketed(spark, f"{path}/postings") if exists(spark, f"{path}/postings.json") else spark.read.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the documents of a stored index."""
    return _read_bucketed(spark, f"{path}/ids")


def write_vectors(docs: DataFrame, path: str, kind: str | TextConfig | Analyzer = "simple", buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", mode: str = "overwrite") -> None:
    """Store the vectors of texts, (id, tsv), in as many files as an index has buckets; mode append adds those of more texts."""
    n = _buckets(docs, buckets)
    vectors(docs.select(id_col, text_col).repartition(n, F.col(id_col)), kind, id_col, text_col).write.mode(mode).option("compression", "zstd").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vocabulary(postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(lexeme, ndoc, nentry): in how many documents a lexeme is, and how often."""
    return postings.groupBy("lexeme").agg(F.count(id_col).alias("ndoc"), F.sum(F.size("positions")).alias("nentry"))


def script_words(spark: SparkSession, docs: DataFrame, text_col: str = "text", most: int = 200_000) -> dict[str, tuple[str, ...]]:
    """Dictionary words of the runs of unspaced scripts in the texts, for Analyzer(words=...).

    The segmenter in the JVM's ICU library works on the driver, so the distinct runs, not the texts, are brought to it; beyond `most` of
    them this raises.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"), F.lit(0))).alias("run")).distinct()
    found = [r.run for r in runs.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct runs of unspaced scripts")
    return {run: dictionary_words(run) for run in found}
