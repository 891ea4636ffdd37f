import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanfold.functions.text import Analyzer, TextConfig, register, source, vector
from spanfold.operators import positional
from spanfold.operators.search import Operand, cover_density, match, rank, recheck, search, search_postings, select
from spanfold.plans import evaluate
from spanfold.plans.lang import QueryError, compile_query
from spanfold.plans.resolve import Resolver
from spanfold.plans.select import query_exact, query_native
from spanfold.sources.index import SLICE_BYTES, _buckets, _reader, _sizes, _table_name, build_postings, read_ids, read_postings, script_words, slices, to_vector, unnest, vectors, vocabulary, write_index, write_postings
from spanfold.streaming.search import append_postings, matching


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain(query, vec, name=None):
    resolver = Resolver.of(name)

    def of(leaf):
        found = resolver.leaf(leaf)
        return evaluate.leaf_positions(vec, found.kind, found.values)

    return evaluate.matches(compile_query(query), of)


CASES = [
    ("red blue green", '"red blue"', True),
    ("red x blue", '"red blue"', False),
    ("red x blue", "red <2> blue", True),
    ("red x blue", "blue <2> red", False),
    ("blue x red", "red <~2> blue", True),
    ("blue x red", "red <-2> blue", False),
    ("red x x x blue", "red <~3> blue", False),
    ("red x x x blue", "red <!~3> blue", True),
    ("red blue x x x x red", "red <!~2> blue", True),
    ("red blue red", "red <!-1> blue", True),
    ("blue red", "red <!-3> blue", True),
    ("red blue", "red <!-3> blue", False),
    ("a x b x x c", "a <~2> b <~3> c", True),
    ("a b z z a c", "a <~1> b <~1> c", False),
    ("a q w b", "(a <~3> b) <~1> q", True),
    ("a b x x c", '"a b" <~3> c', True),
    ("a b x x c", '"a b" <~2> c', False),
    ("a b x c", '"a b" <!~1> c', True),
    ("a b x c", '"a b" <!~2> c', False),
    ("test text tent", "te?t & !toast", True),
    ("biology class", '"*ology class"', True),
    ("id 123456789 here", "id <~1> ##[0-9]{9}##", True),
    ("Upper", "##Upper##", False),
    ("same same", "same <~0> same", True),
    ("a c", "a <-> (b | c)", True),
    ("a (b", "'a' & b", True),
    ("b alone", "!a & b", True),
    ("x", "!a", True),
    ("le café-bar ferme", "café <-> bar", True),
    ("a b-c d", "a <~1> b", False),
    ("100% sure_thing x^y", "100 & sure_*", True),
    ("it is 5", "?", True),
]


def test_cases(spark):
    for text, query, want in CASES:
        vec = vector(source("simple").tokens(text))
        assert plain(query, vec) == want, (text, query)
    df = table(spark, [c[0] for c in CASES]).withColumn("tsv", to_vector())
    row = df.agg(*(F.max(F.when(F.col("doc_id") == i, recheck(q))).alias(f"c{i}") for i, (_, q, _) in enumerate(CASES))).first()
    assert [row[f"c{i}"] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_ordered_operands_that_overlap():
    """Dense spans overlap, whole occurrences do not follow one another."""
    vec = vector(source("simple").tokens("a b c"))
    assert plain('"a b c" <-3> "b c"', vec)
    assert plain('"a b c" <!-3> "b c"', vec)
    assert not plain('"a b" <!-3> "b c"', vec)


def test_the_last_position_is_not_trusted():
    vec = {"a": [5], "b": [6, 16_383]}
    assert plain("a <!~3> b", vec)
    assert not plain("a <!~3> b", {"a": [5], "b": [6]})
    assert evaluate.not_within([5], [6, 16_383], 3) and not evaluate.not_within([5], [6], 3) and not evaluate.not_within([], [1], 3)


def made_up(rng, depth=3):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(["a", "b", "c", "d", "'a'", "a*", "?", "*b", "##[ab]##", '"a b"', '"b c a"', "e"])
    kind = rng.randrange(8)
    left, right = made_up(rng, depth - 1), made_up(rng, depth - 1)
    n = rng.randrange(4)
    return [f"({left}) & ({right})", f"({left}) | ({right})", f"!({left})", f"({left}) <~{n}> ({right})", f"({left}) <-{n}> ({right})", f"({left}) <!~{n}> ({right})", f"({left}) <!-{n}> ({right})", f"({left}) <{n}> ({right})"][kind]


def test_random_queries(spark, tmp_path):
    """Evaluator, vectors and index agree; selection covers search; native and exact forms are what they say."""
    rng = random.Random(42)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(3, 11))) for _ in range(60)]
    vecs = [vector(source("simple").tokens(t)) for t in texts]
    docs = table(spark, texts)
    held = docs.withColumn("tsv", to_vector()).cache()
    postings = build_postings(docs).cache()
    queries = []
    while len(queries) < 60:
        q = made_up(rng)
        try:
            compile_query(q)
            queries.append(q)
        except QueryError:
            pass
    want = {q: {i for i, vec in enumerate(vecs) if plain(q, vec)} for q in queries}
    flags = held.select("doc_id", *(recheck(q).alias(f"q{k}") for k, q in enumerate(queries))).collect()
    for k, q in enumerate(queries):
        assert {r.doc_id for r in flags if r[f"q{k}"]} == want[q], q
    for q in queries[:14]:
        assert {r.doc_id for r in search_postings(postings, q, ids=docs).collect()} == want[q], q
    keyed = []
    for q in queries:
        try:
            select(q)
            keyed.append(q)
        except QueryError:
            pass
    assert len(keyed) > 20
    chosen = held.select("doc_id", *(c.alias(f"{n}{k}") for k, q in enumerate(keyed) for n, c in (("s", select(q)), ("f", search(q))))).collect()
    for k, q in enumerate(keyed):
        selected = {r.doc_id for r in chosen if r[f"s{k}"]}
        assert want[q] <= selected, q
        assert {r.doc_id for r in chosen if r[f"f{k}"]} == want[q], q
        if query_exact(q) is not None:
            assert selected == want[q], q
        if query_native(q) is None:
            assert query_exact(q) is None


def test_predicates(spark):
    df = table(spark, ["a b c a", None, ""]).withColumn("tsv", to_vector())
    got = df.select(
        positional.positions("a"), positional.positions("z"), positional.positions_prefix("a"), positional.positions_matching("[ab]", "regex"), positional.length(),
        positional.within("a", "c", 1), positional.within("b", "a", 0), positional.pre("c", "b", 2), positional.pre("b", "c", 1), positional.not_within("a", "b", 1),
        positional.chain(["a", "c", "b"], [2, 1]), positional.chain(["b", "a"], [0]),
    ).collect()
    assert list(got[0]) == [[1, 4], [], [1, 4], [1, 2, 4], 3, True, False, False, True, True, True, False]
    assert list(got[1]) == [None] * 12
    assert list(got[2]) == [[], [], [], [], 0] + [False] * 7
    for terms, gaps in (([], []), (["a"], [1]), (["a", "b"], [])):
        with pytest.raises(ValueError):
            positional.chain(terms, gaps)


def test_compounds_in_selection_and_recheck(spark):
    """A vector that has only the compound: recheck finds it, selection wants its parts too."""
    df = spark.sql("SELECT map('a-b-c', array(1)) AS tsv UNION ALL SELECT map('a-b-c', array(1), 'a', array(2), 'b', array(3), 'c', array(4)) UNION ALL SELECT map('x', cast(array() AS array<int>))")
    rows = df.select(recheck("a-b-c").alias("r"), select("a-b-c").alias("s"), search("a-b-c").alias("f"), select("x").alias("sx"), recheck("x").alias("rx")).collect()
    assert [tuple(r) for r in rows] == [(True, False, False, False, False), (True, True, True, False, False), (False, False, False, True, False)]


def test_configurations_and_analyzers(spark):
    docs = table(spark, ["the running shoes", "He ran in Café-Bar, mail me@site.org", "walking shoes"])
    for name, cases in {
        "english": {"running <~2> shoe": [0], '"running shoes"': [0], "the": [], "walk*": [2], "RUNNING | ran": [0, 1]},
        "simple_unaccent": {"cafe <-> bar": [1], "Café": [1], "*fe": [1]},
        "icu": {"cafe": [1], "'café'": [1], "'cafe'": [1], "café-bar": [1], "cafebar": [1], "site": [1], "me@site.org": [1], "shoes/none": [0, 2]},
        "icu:english_stem": {"runs": [0], "shoe": [0, 2]},
    }.items():
        held = vectors(docs, name)
        postings = build_postings(docs, name)
        for query, want in cases.items():
            assert sorted(r.doc_id for r in held.where(recheck(query, name)).collect()) == want, (name, query)
            assert sorted(r.doc_id for r in search_postings(postings, Operand(name, query)).collect()) == want, (name, query)
    assert held.where(search("shoes", "icu:english_stem")).count() == 2
    assert held.where(match(Operand("icu:english_stem", "shoes"))).count() == 2


def test_a_scan_reads_only_what_the_query_asks_for(spark, tmp_path):
    docs = table(spark, ["the cat of cats", "a dog"] * 5)
    write_index(docs, str(tmp_path / "ix"))
    postings = read_postings(spark, str(tmp_path / "ix"))

    def plan(query):
        df = search_postings(postings, query, ids=read_ids(spark, str(tmp_path / "ix")))
        return df._jdf.queryExecution().executedPlan().toString(), {r.doc_id for r in df.collect()}

    shown, found = plan("the <~3> of")
    assert "PushedFilters: [Or(EqualTo(lexeme,of),EqualTo(lexeme,the))" in shown and "Python" not in shown
    assert "Exchange" not in shown
    assert found == {0, 2, 4, 6, 8}
    shown, found = plan("!the")
    assert "Exchange hashpartitioning" not in shown and found == {1, 3, 5, 7, 9}
    for again in (lambda: write_postings(build_postings(docs), str(tmp_path / "ix2")), lambda: spark.sql("DROP TABLE " + _table_name(str(tmp_path / "ix2") + "/postings"))):
        again()  # and as another session finds it, which doesn't know the table
        postings = read_postings(spark, str(tmp_path / "ix2"))
        shown, found = plan("the <~3> of")
        assert "Exchange" not in shown and found == {0, 2, 4, 6, 8}
    shown, _ = plan("cat*")
    assert "StringStartsWith(lexeme,cat)" in shown and "positions" not in shown.split("ReadSchema")[1]
    assert vocabulary(postings).where("lexeme = 'cats'").first().asDict() == {"lexeme": "cats", "ndoc": 5, "nentry": 5}


def test_negations_need_all_ids(spark, tmp_path):
    docs = table(spark, ["a", "b", None])
    postings = build_postings(docs)
    with pytest.raises(QueryError):
        search_postings(postings, "!a")
    assert sorted(r.doc_id for r in search_postings(postings, "!a", ids=docs.where("text is not null")).collect()) == [1]
    # as over vectors, a document without a text never matches
    write_index(docs, str(tmp_path / "ix"))
    stored, ids = read_postings(spark, str(tmp_path / "ix")), read_ids(spark, str(tmp_path / "ix"))
    for query, want in (("!a", [1]), ("!(a <~1> b)", [0, 1]), ("!z | a", [0, 1])):
        assert sorted(r.doc_id for r in search_postings(stored, query, ids=ids).collect()) == want
        assert sorted(r.doc_id for r in vectors(docs).where(recheck(query)).collect()) == want


def test_deep_trees(spark):
    docs = table(spark, ["a b", "b"])
    query = "!" * 1000 + "a"
    assert [r.doc_id for r in vectors(docs).where(recheck(query)).collect()] == [0]
    chained = "a" + " <~9> b" * 300
    assert [r.doc_id for r in vectors(docs).where(recheck(chained)).collect()] == [0]
    assert [r.doc_id for r in search_postings(build_postings(docs), chained).collect()] == [0]
    assert [r.doc_id for r in search_postings(build_postings(docs), query, ids=docs).collect()] == [0]


def test_vectors_agree_with_the_plain_tokenizer(spark):
    texts = ["A b-c D", "R&D mp3-Café x.y.z 🎂 C:\\dir 日本語", "w " * 300 + "end", "tail " * 17_000 + "last", "x" * 3000 + " y", None, ""]
    rows = vectors(table(spark, texts)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        assert row.tsv == (None if text is None else vector(source("simple").tokens(text)))
    assert unnest(vectors(table(spark, ["a b a"]))).orderBy("lexeme").collect() == build_postings(table(spark, ["a b a"])).orderBy("lexeme").collect()


def test_ranking(spark):
    assert cover_density([[1], [2]]) == pytest.approx(0.1)
    assert cover_density([[1, 5], [3]]) == pytest.approx(0.1)
    assert cover_density([[1], []]) == 0
    docs = table(spark, ["a x x x b", "a b", "b a b"])
    got = [(r.doc_id, round(r["rank"], 4)) for r in rank(build_postings(docs), "a & b", k=2).collect()]
    assert got == [(2, 0.2), (1, 0.1)]


def test_streams(spark, tmp_path):
    table(spark, ["red blue", "red x x x blue"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    matching(stream, "red <~1> blue").select("doc_id").writeStream.format("memory").queryName("found").trigger(availableNow=True).start().awaitTermination()
    assert [r.doc_id for r in spark.sql("SELECT * FROM found").collect()] == [0]
    append_postings(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    table(spark, ["", "more red"]).withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(str(tmp_path / "in"))
    append_postings(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in search_postings(read_postings(spark, str(tmp_path / "ix")), "red").collect()) == [0, 1, 11]


def test_dictionary_words_of_unspaced_scripts(spark):
    words = script_words(spark, table(spark, ["说 你好世界", "plain", None]))
    assert words["你好世界"] == ("你好", "世界")
    # a query finds such words although its own run is none of the texts'
    register(Analyzer("icu_words", words=words))
    docs = table(spark, ["说 你好世界", "plain", None])
    held, postings = vectors(docs, "icu_words"), build_postings(docs, "icu_words")
    for query, want in (("你好", [0]), ("你好 <-> 世界", [0]), ("世界 <-> 你好", []), ("说 <2> 世界", [0])):
        assert [r.doc_id for r in held.where(recheck(query, "icu_words")).collect()] == want
        assert [r.doc_id for r in search_postings(postings, Operand("icu_words", query)).collect()] == want


def test_long_lists_of_positions_are_merged(spark):
    """Short lists are compared pair by pair, long ones merged: both as the plain evaluator says."""
    rng = random.Random(12)
    texts = []
    for n in (5, 40, 120, 300, 900):
        for share in (0.02, 0.2, 0.5):
            texts.append(" ".join("a" if rng.random() < share else "b" if rng.random() < share else "x" for _ in range(n)))
    texts += ["a " * 100 + "x " * 50 + "b " * 100, "b " * 100 + "x " * 50 + "a " * 100, "x " * 16_400 + "b a", "a " + "x " * 16_400 + "b", "a " * 200, "b " * 200]
    vecs = [vector(source("simple").tokens(t)) for t in texts]
    held = table(spark, texts).withColumn("tsv", to_vector()).cache()
    queries = [f"{p} <{op}{n}> {q}" for p, q in (("a", "b"), ("b", "a"), ("a", "a"), ('"a x"', "b"), ("a", '"b x"'), ('"a x"', '"x b"')) for op in ("~", "-", "!~", "!-") for n in (0, 1, 7, 60)]
    row = held.select("doc_id", *(recheck(q).alias(f"q{k}") for k, q in enumerate(queries))).orderBy("doc_id").collect()
    for k, q in enumerate(queries):
        assert [r[f"q{k}"] for r in row] == [plain(q, v) for v in vecs], q
    for n in (0, 3, 40):
        got = held.select("doc_id", positional.within("a", "b", n).alias("w"), positional.pre("a", "b", n).alias("p"), positional.not_within("a", "b", n).alias("l"), positional.chain(["a", "b", "x"], [n, n + 1]).alias("c")).orderBy("doc_id").collect()
        a, b, x = ([v.get(t, []) for v in vecs] for t in "abx")
        assert [r.w for r in got] == [evaluate.within(p, q, n) for p, q in zip(a, b)]
        assert [r.p for r in got] == [evaluate.precedes(p, q, n) for p, q in zip(a, b)]
        assert [r.l for r in got] == [evaluate.not_within(p, q, n) for p, q in zip(a, b)]
        assert [r.c for r in got] == [evaluate.chain([p, q, z], [n, n + 1]) for p, q, z in zip(a, b, x)]


def test_a_name_registered_anew_is_resolved_anew(spark):
    docs = table(spark, ["red", "RED"])
    for change, want in ((str.upper, "RED"), (str.title, "Red")):
        register(TextConfig("changing", change))
        assert vectors(docs, "changing").where(recheck("red", "changing")).count() == 2
        assert [r.lexeme for r in build_postings(docs, "changing").select("lexeme").distinct().collect()] == [want]


def test_regular_expressions_are_checked_in_the_dialect_that_runs(spark):
    for query in ("##(?P<n>red)##", "##[[:nothing:]]##", "##(##", "a & ##*##", "##(?<n>a)(?<n>b)##"):
        with pytest.raises(QueryError):
            recheck(query)
    held = vectors(table(spark, ["re_d 12"]))
    assert held.where(recheck("##[[:word:]]+##")).count() == 1
    assert held.where(recheck(r"##\m[[:digit:]]{2}\M##")).count() == 1


def test_analyzed_stretches_are_the_tokens_of_the_whole_text():
    """A text is cut at spaces where no token reaches over one, and stays whole where one may."""
    rng = random.Random(7)
    atoms = ["a", "B-c", "x.y", "R&D", "l'amour", "http://a.b/c?d", "me@x.org", " ", " ", "\n", "\u3000", "é", "\u0301", "\u200d", "🎂", "🏽", "🇩🇪", "日本", "5.", "(w)", "_", "-", "'"]
    for name in ("icu", "unicode", "icu_accent", "icu_no_emoji", "icu:english_stem"):
        reader = source(name)
        for _ in range(2_000):
            text = "".join(rng.choice(atoms) for _ in range(rng.randrange(14)))
            got, at = [], 0
            for stretch in reader.stretches(text):
                tokens, n = reader.cut(stretch)
                got, at = got + [(x, p + at) for x, p in tokens], at + n
            assert got == reader.tokens(text), ascii(text)


def test_texts_are_read_in_slices_of_bounded_bytes():
    assert list(slices(np.array([3, 3, 3, 9, 0, 1]), 4)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(slices(np.array([], np.int64), 4)) == []
    texts = pa.array(["word " * 2_000] * 1_000 + [None, ""])
    for kind in ("icu", "english"):
        _, read = _reader(kind, "text")
        for start, length in slices(_sizes(texts), SLICE_BYTES):
            assert len(read(texts.slice(start, length))[0]) <= SLICE_BYTES // 5 + 2_000
            break


def test_unnesting_makes_vectors_once(spark):
    held = unnest(vectors(table(spark, ["a b a", None, ""]), "icu"))
    assert held._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in held.collect()) == [(0, "a", [1, 3]), (0, "b", [2])]


def test_buckets_follow_the_bytes_of_the_tables(spark, tmp_path, monkeypatch):
    """The share that Spark takes two columns for, by their types alone, can be far from theirs."""
    docs = spark.range(2_000).selectExpr("id AS doc_id", "repeat(uuid(), 20) AS text", *(f"id AS c{i}" for i in range(30)))
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    read, held = spark.read.parquet(str(tmp_path / "docs")), sum(f.stat().st_size for f in (tmp_path / "docs").glob("*.parquet"))
    monkeypatch.setattr("spanfold.sources.index.BUCKET_BYTES", 1 << 14)
    assert held >> 14 > 16
    assert _buckets(read.select("doc_id", "text"), None) >= held >> 14
    assert _buckets(read.select("doc_id", "text"), 3) == 3
