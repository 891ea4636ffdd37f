import pytest
import zstandard

from spanfold.llm.warc import dictionary_of, parse, read_at, read_warc, store_archives, write_warc

SCHEMA = "page_id long, url string, html string, content string, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_round_trip_of_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    archives = write_warc(table, archive_bytes=60_000).collect()
    assert len(archives) > 1
    want = {r.page_id: (r.url, r.html) for r in table.collect()}
    for a in archives:
        assert a.records == len(a["index"])
        assert len(a.content) < a.raw_bytes
        for entry in a["index"]:
            fields, body = read_at(a.content, entry.offset, entry.length)
            url, html = want.pop(entry.id)
            assert (fields["WARC-Target-URI"], body.decode()) == (url, html)
            assert fields["X-Page-ID"] == str(entry.id)
    assert not want


def test_the_dictionary_comes_first_and_is_needed(spark):
    a = write_warc(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).first()
    assert a.content[:4] == bytes.fromhex("5D2A4D18")
    assert len(dictionary_of(a.content).as_bytes()) == a.dictionary_bytes
    entry = a["index"][0]
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(a.content[entry.offset : entry.offset + entry.length])


def test_edge_rows(spark):
    rows = [(1, "http://a/", "<p>x"), (None, None, None), (1, "http://a/", "<p>x"), (2, "", ""), (3, "http://b/ \r\nc", "y" * 400_000)]
    archives = write_warc(pages(spark, rows), archive_bytes=100_000)
    back = sorted((str(r.page_id), str(r.url), str(r.html)) for r in read_warc(archives).collect())
    want = [(str(i), "http://b/%20%0D%0Ac" if i == 3 else str(u), str(h)) for i, u, h in rows]
    assert back == sorted(want)
    assert write_warc(pages(spark, [])).collect() == []
    assert read_warc(write_warc(pages(spark, []))).collect() == []


def test_records_are_well_formed(spark):
    a = write_warc(pages(spark, [(5, "http://a/", "é" * 10)])).first()
    fields, body = read_at(a.content, a["index"][0].offset, a["index"][0].length)
    assert fields["Content-Length"] == "20" == str(len(body))
    assert fields["WARC-Type"] == "resource"
    assert parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n") == ({"Content-Length": "2"}, b"ab")


def test_archives_are_written_as_files(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(3)
    archives = write_warc(table, archive_bytes=60_000)
    for _ in range(2):  # what is written again takes the place of what was there
        stored = store_archives(archives, f"file://{tmp_path}/out").collect()
        files = sorted((tmp_path / "out").iterdir())
        assert sorted(r.path for r in stored) == [str(f) for f in files] and len(files) > 1
    back = read_warc(spark.read.format("binaryFile").load(str(tmp_path / "out")))
    assert sorted((r.page_id, r.url, r.html) for r in back.collect()) == sorted((str(r.page_id), r.url, r.html) for r in table.collect())
    assert store_archives(write_warc(pages(spark, [])), f"file://{tmp_path}/none").collect() == []
