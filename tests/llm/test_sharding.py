import hashlib
from fractions import Fraction

from spanfold.llm.sharding import exact_fraction, interleave, running_starts, write_shards
from tests.llm import edge


def brute(rows, shards, seed):
    """shard by (id, source), for unique ids."""
    by = {}
    for i, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
    order = sorted((Fraction(2 * r - 1, 2 * len(v)), s, i) for s, v in by.items() for r, (_, i) in enumerate(sorted(v), 1))
    return {i: (p, p * shards // len(order)) for p, (_, _, i) in enumerate(order)}


def data(spark, n=400):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(n)]
    return rows, edge.table(spark, rows)


def test_against_brute_force(spark):
    rows, df = data(spark)
    want = brute([(r[0], r[3]) for r in rows], 7, 3)
    for options in ({}, {"rows_a_bucket": 20}, {"most_sources": 1, "rows_a_bucket": 50}):
        got = interleave(df, 7, 3, **options).collect()
        assert {r.doc_id: (r.shard_pos, r.shard) for r in got} == want
        assert len(got) == len(rows)


def test_every_shard_has_the_mixture(spark):
    rows, df = data(spark, 1000)
    got = interleave(df, 5).toPandas()
    share = (got.source == "hot").mean()
    for _, part in got.groupby("shard"):
        assert len(part) == 200
        assert abs((part.source == "hot").sum() - share * 200) <= 2


def test_edge_rows(spark):
    more = ["__own", "__pos", "__shard", "__row", "__source", "__key", "__bucket", "__tie", "__hash", "__rank", "__before", "__sizes", "__slot", "__fraction", "__start", "__chunk", "__n"]
    df = edge.table(spark, extra=["SHARD", "shard_pos", *more])
    for options in ({}, {"most_sources": 1}):
        got = interleave(df, 3, **options)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *more, "shard", "shard_pos"]
        rows = got.collect()
        assert sorted(r.shard_pos for r in rows) == list(range(len(edge.ROWS)))
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r[0]), str(r[1])) for r in edge.ROWS)
        assert {r[n] for r in rows for n in more} == {"mine"}
    assert interleave(edge.table(spark, []), 3).collect() == []


def test_shards_are_written_in_order(spark, tmp_path):
    _, df = data(spark)
    write_shards(interleave(df, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 400
    assert back.groupBy("shard").count().count() == 4


def test_both_ways_order_fractions_exactly(spark):
    """Fractions that agree in their first 16 digits are told apart, and equal ones are not."""
    from pyspark.sql import functions as F

    big = [(4 * 10**16, 10**17 - 1), (4 * 10**16 + 1, 10**17 - 1), (4 * 10**16, 10**17 - 3), (1, 3), (2, 9), (2, 3)]
    df = spark.createDataFrame(big, "__rank long, __size long").select("*", exact_fraction().alias("f"))
    got = {(r["__rank"], r["__size"]): (int(r.f.high), int(r.f.low)) for r in df.collect()}
    order = sorted(big, key=lambda x: Fraction(2 * x[0] - 1, 2 * x[1]))
    assert [got[x] for x in order] == sorted(got.values())
    assert got[1, 3] != got[2, 3] and len(set(got.values())) == len({Fraction(2 * a - 1, 2 * b) for a, b in big})
    starts = running_starts(spark.range(50).select(F.col("id").alias("__slot"), (F.col("id") + 1).alias("__n")), chunk=7)
    assert {r["__slot"]: r["__start"] for r in starts.collect()} == {i: i * (i + 1) // 2 for i in range(50)}
