"""WARC archives under Zstandard: a dictionary in a leading skippable frame, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "archive string, records int, dictionary_bytes int, raw_bytes long, index array<struct<id:{id},offset:bigint,length:bigint>>, content binary"


def record(kind: str, name: str, date: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    """A WARC/1.1 record with its digest and the two line ends that follow it."""
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def page_record(name: str, date: str, page_id: object, url: str | None, html: bytes | None) -> bytes:
    fields = [] if url is None else [("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))]
    fields.append(("Content-Type", "text/html; charset=utf-8"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if html is None:
        fields.append(("X-Content", "null"))
    return record("resource", name, date, fields, html or b"")


def archive(label: str, rows: list[tuple[object, str | None, bytes | None]], date: str) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """The bytes of an archive, its dictionary's size, its records' size, and (offset, length) of each row's frame."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, label)
    records = [page_record(str(uuid.uuid5(space, str(k))), date, *row) for k, row in enumerate(rows)]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8)
    except zstandard.ZstdError:  # too few records to choose from: they serve as they are
        dictionary = zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    inner = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    dictionary.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary).compress
    out = [struct.pack("<II", DICTIONARY_FRAME, len(inner)), inner]
    about = record("warcinfo", str(space), date, [("WARC-Filename", label), ("Content-Type", "application/warc-fields")], b"software: spanfold\r\nformat: WARC File Format 1.1\r\n")
    out.append(compress(about))
    at, places = sum(map(len, out)), []
    for r in records:
        out.append(compress(r))
        places.append((at, len(out[-1])))
        at += len(out[-1])
    return b"".join(out), len(dictionary.as_bytes()), sum(map(len, records)), places


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """One row for each archive: its name, its counts, its index (id, offset, length of each record's frame) and its bytes.

    Each task writes the pages it reads into archives of about archive_bytes, so nothing is exchanged and an archive
    is bounded in memory. An archive's dictionary is trained on all of its records and stands, compressed, in a
    leading skippable frame, as readers of .warc.zst expect; a warcinfo record and the pages follow as resource
    records, each a frame of its own that can be read at its offset with the dictionary alone.

    A null url leaves out the target, null HTML is an empty block with X-Content: null, a null id has no X-Page-ID.
    Control characters and spaces of a url are percent-encoded. Empty and very long pages and repeated rows are records like
    others (a page longer than archive_bytes closes its archive). store_archives() writes the archives as files. No rows give no archive. Other columns are not archived.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        ids: list[pa.Array] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            label = f"part-{part:05d}-{number:05d}.warc.zst"
            content, size, raw, places = archive(label, rows, date)
            index = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array([a for a, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())], names=["id", "offset", "length"])
            out = [pa.array([label]), pa.array([len(rows)], pa.int32()), pa.array([size], pa.int32()), pa.array([raw], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), index), pa.array([content], pa.binary())]
            number, held = number + 1, 0
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(out, names=["archive", "records", "dictionary_bytes", "raw_bytes", "index", "content"])

        for batch in batches:
            first = 0
            for k, (i, url, source) in enumerate(zip(*(batch.column(c) for c in range(3)))):
                body = source.as_buffer()  # the page's bytes; none for null
                rows.append((i.as_py(), url.as_py(), None if body is None else body.to_pybytes()))
                held += (0 if body is None else body.size) + 200
                if held >= archive_bytes:
                    ids.append(batch.column(0).slice(first, k + 1 - first))
                    first = k + 1
                    yield close()
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if rows:
            yield close()

    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return picked.mapInArrow(run, SCHEMA.format(id=kind))


def store_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive of write_warc() as a file of its name in the folder, and give (path, records, bytes) of each.

    The folder is a URI of a file system that all executors reach and Arrow knows (file, hdfs, s3, gs). A file is written under a name of its own
    and then moved to its place, so a task that runs again, or twice at once, leaves whole files alone. Archives without rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, records, content in zip(*(batch.column(c) for c in range(3))):
                place, staged = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(staged, compression=None) as to:
                    to.write(content.as_buffer())
                system.move(staged, place)
                out.append((place, records.as_py(), content.as_buffer().size))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["path", "records", "bytes"])

    return archives.select("archive", "records", "content").mapInArrow(run, "path string, records int, bytes long")


def dictionary_of(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary that an archive begins with."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    inner = content[8 : 8 + size]
    if inner[:4] == b"\x28\xb5\x2f\xfd":
        inner = zstandard.ZstdDecompressor().decompress(inner)
    return zstandard.ZstdCompressionDict(inner)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_at(content: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The record of one frame."""
    return parse(zstandard.ZstdDecompressor(dict_data=dictionary_of(content)).decompress(content[offset : offset + length]))


def read_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """(page_id as text, url, html) of each resource record of the archives; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not content.is_valid:
                    continue
                data = content.as_py()
                known = zstandard.ZstdDecompressor(dict_data=dictionary_of(data))
                at, rows = 8 + struct.unpack_from("<I", data, 4)[0], []
                while at < len(data):
                    frame, raw = known.decompressobj(), b""
                    while not frame.eof:
                        raw += frame.decompress(data[at : at + 65_536])
                        at = min(len(data), at + 65_536)
                    at -= len(frame.unused_data)
                    fields, body = parse(raw)
                    if fields["WARC-Type"] == "resource":
                        rows.append((fields.get("X-Page-ID"), fields.get("WARC-Target-URI"), None if fields.get("X-Content") == "null" else body.decode("utf-8", "surrogatepass")))
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["page_id", "url", "html"])

    return archives.select(content_col).mapInArrow(run, "page_id string, url string, html string")
