"""Queries over the documents table, one for each operator, and the SQL that defines the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.functions.text import PLAIN
from spanfold.operators import positional
from spanfold.operators.search import Operand, rank, recheck, search, search_postings, select
from spanfold.plans.select import query_exact, query_native, query_skeleton
from spanfold.sources.index import build_postings, plain_tokens, read_ids, read_postings, read_vectors, unnest, vectors, vocabulary, write_index, write_vectors
from spanfold.storage import file_state, fresh_path
from spanfold.streaming.search import matching

Query = Callable[[SparkSession, str], DataFrame]
_stored: dict[tuple[str, str, str, str], str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _path(spark: SparkSession, sf_dir: str, kind: str, what: str, write: Callable[..., None]) -> str:
    """Where something made of all documents is stored: once a session for each state of the documents' files."""
    key = (spark.sparkContext.applicationId, file_state(spark, f"{sf_dir}/documents.parquet"), kind, what)
    if key not in _stored:
        path = fresh_path(spark, what)
        write(documents(spark, sf_dir), path, kind)
        _stored[key] = path
    return _stored[key]


def index(spark: SparkSession, sf_dir: str, kind: str = "simple") -> DataFrame:
    """The stored index of all documents."""
    return read_postings(spark, _path(spark, sf_dir, kind, "index", write_index))


def index_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that the index holds."""
    return read_ids(spark, _path(spark, sf_dir, "simple", "index", write_index))


def stored_vectors(spark: SparkSession, sf_dir: str, kind: str = "simple") -> DataFrame:
    """The stored vectors of all documents."""
    return read_vectors(spark, _path(spark, sf_dir, kind, "vectors", write_vectors))


def shown(positions: str = "positions"):
    """An array of positions as text, the same in every engine."""
    return F.concat_ws(",", F.transform(positions, lambda x: x.cast("string"))).alias("positions")


# --- SQL

_TOKENS = f"""words AS (
  SELECT doc_id, flatten(list_transform(regexp_extract_all(lower(text), '{PLAIN}'), lambda x: CASE WHEN contains(x, '-') THEN list_concat([x], string_split(x, '-')) ELSE [x] END)) AS t
  FROM documents),
tok AS (SELECT doc_id, unnest(t) AS lexeme, generate_subscripts(t, 1) AS pos FROM words)"""
_P = f"""WITH {_TOKENS},
p AS (SELECT doc_id, lexeme, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lexeme ORDER BY pos) AS rn
  FROM (SELECT DISTINCT doc_id, lexeme, CAST(least(pos, 16383) AS INTEGER) AS pos FROM tok WHERE strlen(lexeme) <= 2046)) WHERE rn <= 256)"""


def sql(body: str) -> str:
    return f"{_P}\n{body}"


def pair(a: str, b: str, condition: str) -> str:
    """Documents with an x of a and a y of b under the condition."""
    return sql(f"SELECT DISTINCT x.doc_id FROM p x JOIN p y USING (doc_id) WHERE x.{a} AND y.{b} AND {condition}")


THE, OF, AND = "lexeme = 'the'", "lexeme = 'of'", "lexeme = 'and'"
#: name: query text, and the SQL of the matching documents, written from the operators' definitions
DSL: dict[str, tuple[str, str]] = {
    "op_term": ("license", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme = 'license'")),
    "op_literal": ("'2.0'", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme = '2.0'")),
    "op_and": ("the & license", sql("SELECT doc_id FROM p WHERE lexeme = 'the' INTERSECT SELECT doc_id FROM p WHERE lexeme = 'license'")),
    "op_or": ("license | example", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme IN ('license', 'example')")),
    "op_not": ("!the", sql("SELECT doc_id FROM documents WHERE text IS NOT NULL EXCEPT SELECT doc_id FROM p WHERE lexeme = 'the'")),
    "op_andnot": ("license & !(apache | mit)", sql("SELECT doc_id FROM p WHERE lexeme = 'license' EXCEPT SELECT doc_id FROM p WHERE lexeme IN ('apache', 'mit')")),
    "op_prefix": ("licen*", sql("SELECT DISTINCT doc_id FROM p WHERE starts_with(lexeme, 'licen')")),
    "op_suffix": ("*cense", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme LIKE '%cense'")),
    "op_infix": ("lic*se", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme LIKE 'lic%se'")),
    "op_qmark": ("licen?e", sql("SELECT DISTINCT doc_id FROM p WHERE lexeme LIKE 'licen_e'")),
    "op_regex": ("##[0-9]{3,}##", sql("SELECT DISTINCT doc_id FROM p WHERE regexp_full_match(lexeme, '[0-9]{3,}')")),
    "op_phrase": ('"under the apache"', sql("SELECT DISTINCT x.doc_id FROM p x JOIN p y USING (doc_id) JOIN p z USING (doc_id) WHERE x.lexeme = 'under' AND y.lexeme = 'the' AND z.lexeme = 'apache' AND y.pos = x.pos + 1 AND z.pos = y.pos + 1")),
    "op_adj": ("of <-> the", pair(OF, THE, "y.pos = x.pos + 1")),
    "op_exact": ("of <2> the", pair(OF, THE, "y.pos = x.pos + 2")),
    "op_or_distribute": ("(of | and) <2> the", pair("lexeme IN ('of', 'and')", THE, "y.pos = x.pos + 2")),
    "op_within": ("the <~3> of", pair(THE, OF, "abs(x.pos - y.pos) <= 3")),
    "op_pre": ("the <-3> of", pair(THE, OF, "y.pos - x.pos BETWEEN 0 AND 3")),
    "op_notwithin": ("the <!~20> of", sql("SELECT DISTINCT doc_id FROM p x WHERE lexeme = 'the' AND NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.lexeme = 'of' AND abs(x.pos - y.pos) <= 20) UNION SELECT x.doc_id FROM p x JOIN p y USING (doc_id) WHERE x.lexeme = 'the' AND y.lexeme = 'of' AND y.pos = 16383")),
    "op_notpre": ("the <!-20> of", sql("SELECT DISTINCT doc_id FROM p x WHERE lexeme = 'the' AND NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.lexeme = 'of' AND y.pos - x.pos BETWEEN 0 AND 20) UNION SELECT x.doc_id FROM p x JOIN p y USING (doc_id) WHERE x.lexeme = 'the' AND y.lexeme = 'of' AND y.pos = 16383")),
    "op_wild_prox": ("th* <~1> licen*", pair("lexeme LIKE 'th%'", "lexeme LIKE 'licen%'", "abs(x.pos - y.pos) <= 1")),
    "op_regex_prox": ("version <~2> ##[0-9]([.][0-9])?##", pair("lexeme = 'version'", "lexeme SIMILAR TO '[0-9]([.][0-9])?'", "abs(x.pos - y.pos) <= 2")),
    "op_chain_dsl": (
        "the <~5> of <~5> and",
        sql("""SELECT DISTINCT s.doc_id FROM (SELECT x.doc_id, least(x.pos, y.pos) AS a, greatest(x.pos, y.pos) AS b FROM p x JOIN p y USING (doc_id)
  WHERE x.lexeme = 'the' AND y.lexeme = 'of' AND abs(x.pos - y.pos) <= 5) s JOIN p z USING (doc_id) WHERE z.lexeme = 'and' AND z.pos BETWEEN s.a - 5 AND s.b + 5"""),
    ),
    "op_compound": (
        '"of the" <~4> (and | license)',
        sql("""SELECT DISTINCT x.doc_id FROM p x JOIN p y USING (doc_id) JOIN p z USING (doc_id) WHERE x.lexeme = 'of' AND y.lexeme = 'the' AND y.pos = x.pos + 1
  AND z.lexeme IN ('and', 'license') AND z.pos BETWEEN x.pos - 4 AND y.pos + 4"""),
    ),
    "op_group_notwithin": (
        "(the <~3> of) <!~10> and",
        sql("""SELECT DISTINCT doc_id FROM (SELECT x.doc_id, least(x.pos, y.pos) AS a, greatest(x.pos, y.pos) AS b FROM p x JOIN p y USING (doc_id)
  WHERE x.lexeme = 'the' AND y.lexeme = 'of' AND abs(x.pos - y.pos) <= 3) s
WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.doc_id = s.doc_id AND z.lexeme = 'and' AND z.pos BETWEEN s.a - 10 AND s.b + 10)
  OR EXISTS (SELECT 1 FROM p z WHERE z.doc_id = s.doc_id AND z.lexeme = 'and' AND z.pos = 16383)"""),
    ),
}


def indexed(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_postings(index(spark, sf_dir), text, ids=index_ids(spark, sf_dir))

    return run


def over_vectors(make) -> Query:
    """(doc_id, matched) of a predicate on every document's stored vector."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_vectors(spark, sf_dir).select("doc_id", make().alias("matched"))

    return run


def filtered(make, stored: bool = True) -> Query:
    """Documents whose vector, stored or built while the query runs, satisfies a predicate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = stored_vectors(spark, sf_dir) if stored else vectors(documents(spark, sf_dir))
        return held.where(make()).select("doc_id")

    return run


def flags(condition: str) -> str:
    """(doc_id, matched) in SQL, for documents x that satisfy a condition on p."""
    return sql(f"SELECT doc_id, doc_id IN ({condition}) AS matched FROM documents WHERE text IS NOT NULL")


def bare(statement: str) -> str:
    """The SELECT of a statement made by sql()."""
    return statement[len(_P) :]


# --- queries over the index and the vectors


def tok_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(plain_tokens("text")).alias("at", "lexeme")).select("doc_id", "lexeme", (F.col("at") + 1).alias("pos"))


def unnest_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnest(stored_vectors(spark, sf_dir)).select("doc_id", "lexeme", shown())


def gin_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).where("lexeme IN ('the', 'license')").select("doc_id", "lexeme", shown())


def gin_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).where("startswith(lexeme, 'licen')").select("doc_id", "lexeme", shown())


def len_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_vectors(spark, sf_dir).select("doc_id", positional.length().alias("lexemes"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(index(spark, sf_dir))


def positions_of(make) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored_vectors(spark, sf_dir).select("doc_id", make().alias("positions")).where("size(positions) > 0").select("doc_id", shown())

    return run


def positions_sql(condition: str) -> str:
    return sql(f"SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT DISTINCT doc_id, pos FROM p WHERE {condition}) GROUP BY doc_id")


def src_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are kept up as rows come: those of half of the documents are stored, those of the others appended, then all are searched."""
    docs, path = documents(spark, sf_dir), fresh_path(spark, "generated")
    write_vectors(docs.where("doc_id % 2 = 0"), path)
    write_vectors(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), path, mode="append")
    return read_vectors(spark, path).where(recheck(DSL["op_pre"][0])).select("doc_id")


def src_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index selects, the vectors of the candidates are made from their texts, and the recheck decides."""
    docs = documents(spark, sf_dir)
    chosen = search_postings(index(spark, sf_dir), "the & of")
    return vectors(docs.join(chosen, "doc_id", "left_semi")).where(recheck(DSL["op_within"][0])).select("doc_id")


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search on documents as a stream."""
    schema = documents(spark, sf_dir).schema
    # a table is a file in some folders and a folder of files in others
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    out = fresh_path(spark, "stream")
    matching(stream, DSL["op_within"][0]).select("doc_id").writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("doc_id long").parquet(out)


def compose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search combined with a semi-join and a scalar condition."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 1000").select("doc_id", "lang")
    found = search_postings(index(spark, sf_dir), DSL["op_within"][0])
    return sizes.join(found, "doc_id", "left_semi").join(good, "doc_id", "left_semi")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(index(spark, sf_dir), "the & license").select("doc_id", F.round("rank", 9).alias("rank"))


def top_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(index(spark, sf_dir), "the & license").select("doc_id", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(10)


def skel_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_vectors(spark, sf_dir).where(select("the <~3> of & licen*")).select("doc_id")


def eq_vocab_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard as the set of the vocabulary's lexemes that it covers."""
    postings = index(spark, sf_dir)
    words = vocabulary(postings).where("lexeme LIKE '%cense'").select("lexeme")
    return postings.join(words, "lexeme", "left_semi").select("doc_id").distinct()


def eq_companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard that a companion term narrows."""
    return search_postings(index(spark, sf_dir), "the & *cense")


def occurrences(spark: SparkSession, sf_dir: str, lexeme: str) -> DataFrame:
    """(doc_id, pos) of a lexeme, a row for each occurrence."""
    return index(spark, sf_dir).where(F.col("lexeme") == lexeme).select("doc_id", F.explode("positions").alias("pos"))


def eq_notwithin_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-within as an anti join of occurrences: those of one word without one of the other in a range of positions."""
    x, y = occurrences(spark, sf_dir, "the").alias("x"), occurrences(spark, sf_dir, "of").alias("y")
    lone = x.join(y, F.expr("x.doc_id = y.doc_id AND y.pos BETWEEN x.pos - 20 AND x.pos + 20"), "left_anti").select("doc_id")
    untold = x.join(y.where("pos = 16383"), "doc_id", "left_semi").select("doc_id")
    return lone.unionAll(untold).distinct()


PARITY = ["op_term", "op_andnot", "op_prefix", "op_phrase", "op_exact", "op_within", "op_notpre", "op_chain_dsl", "op_compound", "op_group_notwithin"]


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several queries: how many documents match over the index, and on how many index and vectors disagree (EXCEPT ALL both ways)."""
    held = stored_vectors(spark, sf_dir)
    return disagreements(spark, {name: search_postings(index(spark, sf_dir), DSL[name][0]) for name in PARITY}, held, {name: recheck(DSL[name][0]) for name in PARITY})


def disagreements(spark: SparkSession, found: dict[str, DataFrame], held: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(query, matches, disagreements) of ids found and of those of the rows held that pass a test, as bags. What is held is read once, for all tests."""
    passed = F.filter(F.array(*(F.when(test, name) for name, test in tests.items())), lambda name: name.isNotNull())
    rows = spark.createDataFrame([(name,) for name in found], "query string").selectExpr("query", "cast(null AS bigint) AS doc_id", "0 AS a", "0 AS b")
    rows = rows.unionAll(held.select(F.explode_outer(passed).alias("query"), "doc_id", F.lit(0), F.lit(1)).where("query IS NOT NULL"))
    for name, ids in found.items():
        rows = rows.unionAll(ids.select(F.lit(name), "doc_id", F.lit(1), F.lit(0)))
    each = rows.groupBy("query", "doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.groupBy("query").agg(F.sum("a").alias("matches"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("disagreements"))


def by_source(operand: Operand) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search_postings(index(spark, sf_dir, operand.source), operand)

    return run


def analyzer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(documents(spark, sf_dir), "icu").select("doc_id", "lexeme", shown())


TEXTS = ["a <~1> b", '"quick fox" & !slow', "appl* <-> pie", "(a | b) <2> c", "x <!~3> y", "te?t & (p | q)"]


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(q, query_skeleton(q), query_native(q), query_exact(q)) for q in TEXTS]
    return spark.createDataFrame(rows, "query string, skeleton string, native string, exact string")


_WITHIN = bare(DSL["op_within"][1])
_CHAIN = """SELECT DISTINCT x.doc_id FROM p x JOIN p y USING (doc_id) JOIN p z USING (doc_id) WHERE x.lexeme = 'the' AND y.lexeme = 'of' AND z.lexeme = 'and'
  AND abs(x.pos - y.pos) <= 2 AND abs(y.pos - z.pos) <= 2"""
_RANKED = """m AS (SELECT doc_id, lexeme, pos, lag(lexeme) OVER w AS earlier, lag(pos) OVER w AS place FROM p WHERE lexeme IN ('the', 'license') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, round(sum(0.1::DOUBLE / (1 + pos - place - 1)), 9) AS rank FROM m WHERE earlier <> lexeme GROUP BY doc_id)"""

QUERIES: dict[str, Query] = {name: indexed(text) for name, (text, _) in DSL.items()} | {
    "tok_simple": tok_simple,
    "unnest_tsv": unnest_tsv,
    "gin_index": gin_index,
    "gin_prefix": gin_prefix,
    "len_tsv": len_tsv,
    "vocab": vocab,
    "positions": positions_of(lambda: positional.positions("the")),
    "positions_prefix": positions_of(lambda: positional.positions_prefix("licen")),
    "positions_matching": positions_of(lambda: positional.positions_matching("l*e")),
    "within": over_vectors(lambda: positional.within("the", "of", 3)),
    "pre": over_vectors(lambda: positional.pre("the", "of", 3)),
    "not_within": over_vectors(lambda: positional.not_within("the", "of", 20)),
    "chain": over_vectors(lambda: positional.chain(["the", "of", "and"], [2, 2])),
    "recheck": over_vectors(lambda: recheck(DSL["op_compound"][0])),
    "search": filtered(lambda: search("the <~3> of")),
    "search_exact": filtered(lambda: search('"of the" & licen*')),

    "src_stored": filtered(lambda: recheck(DSL["op_within"][0])),
    "src_onthefly": filtered(lambda: recheck(DSL["op_within"][0]), stored=False),
    "src_generated": src_generated,
    "src_functional": src_functional,
    "stream_match": stream_match,
    "skel_match": skel_match,
    "compose_filter": compose_filter,
    "rank": ranked,
    "rank_top": top_ranked,
    "eq_within_enum": indexed(" | ".join(f"(the <{k}> of) | (of <{k}> the)" for k in range(4))),
    "eq_pre_enum": indexed(" | ".join(f"(the <{k}> of)" for k in range(4))),
    "eq_notwithin_exists": eq_notwithin_exists,
    "eq_vocab_or": eq_vocab_or,
    "eq_companion": eq_companion,
    "index_scan_parity": parity,
    "query_texts": query_texts,
    "search_cfg": by_source(Operand("english", "licensed <~3> apaches")),
    "search_analyzer": by_source(Operand("icu", "LICENSE <~3> apache")),
    "tok_analyzer_documents": analyzer_vectors,
}

#: Words of English texts that have the stems of the configuration's query.
STEMMED = "lexeme IN ('license', 'licensed', 'licenses', 'licensing', 'licens')", "lexeme IN ('apache', 'apaches', 'apach')"

ORACLE_SQL: dict[str, str] = {name: statement for name, (_, statement) in DSL.items()} | {
    "search_cfg": pair(*STEMMED, "abs(x.pos - y.pos) <= 3"),
    "search_analyzer": pair("lexeme = 'license'", "lexeme = 'apache'", "abs(x.pos - y.pos) <= 3"),
    "tok_simple": f"WITH {_TOKENS} SELECT doc_id, lexeme, CAST(pos AS INTEGER) AS pos FROM tok",
    "unnest_tsv": sql("SELECT doc_id, lexeme, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY doc_id, lexeme"),
    "gin_index": sql("SELECT doc_id, lexeme, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE lexeme IN ('the', 'license') GROUP BY doc_id, lexeme"),
    "gin_prefix": sql("SELECT doc_id, lexeme, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE starts_with(lexeme, 'licen') GROUP BY doc_id, lexeme"),
    "len_tsv": sql("SELECT d.doc_id, CAST(count(DISTINCT p.lexeme) AS INTEGER) AS lexemes FROM documents d LEFT JOIN p USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id"),
    "vocab": sql("SELECT lexeme, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM p GROUP BY lexeme"),
    "positions": positions_sql("lexeme = 'the'"),
    "positions_prefix": positions_sql("starts_with(lexeme, 'licen')"),
    "positions_matching": positions_sql("lexeme LIKE 'l%e'"),
    "within": flags(_WITHIN),
    "pre": flags(bare(DSL["op_pre"][1])),
    "not_within": flags(bare(DSL["op_notwithin"][1])),
    "chain": flags(_CHAIN),
    "recheck": flags(bare(DSL["op_compound"][1])),
    "search": DSL["op_within"][1],
    "search_exact": sql("SELECT DISTINCT x.doc_id FROM p x JOIN p y USING (doc_id) WHERE x.lexeme = 'of' AND y.lexeme = 'the' AND y.pos = x.pos + 1 INTERSECT SELECT doc_id FROM p WHERE starts_with(lexeme, 'licen')"),

    "src_stored": DSL["op_within"][1],
    "src_onthefly": DSL["op_within"][1],
    "src_generated": DSL["op_pre"][1],
    "src_functional": DSL["op_within"][1],
    "stream_match": DSL["op_within"][1],
    "skel_match": sql("SELECT doc_id FROM p WHERE lexeme = 'the' INTERSECT SELECT doc_id FROM p WHERE lexeme = 'of' INTERSECT SELECT doc_id FROM p WHERE starts_with(lexeme, 'licen')"),
    "compose_filter": sql(f"SELECT doc_id, lang FROM documents WHERE n_chars > 1000 AND doc_id IN ({_WITHIN}) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "rank": f"{_P}, {_RANKED} SELECT * FROM r",
    "rank_top": f"{_P}, {_RANKED} SELECT * FROM r ORDER BY rank DESC, doc_id LIMIT 10",
    "eq_within_enum": DSL["op_within"][1],
    "eq_pre_enum": DSL["op_pre"][1],
    "eq_notwithin_exists": DSL["op_notwithin"][1],
    "eq_vocab_or": DSL["op_suffix"][1],
    "eq_companion": sql("SELECT doc_id FROM p WHERE lexeme = 'the' INTERSECT SELECT doc_id FROM p WHERE lexeme LIKE '%cense'"),
    "index_scan_parity": " UNION ALL ".join(f"SELECT '{name}' AS query, (SELECT count(*) FROM ({DSL[name][1]})) AS matches, CAST(0 AS BIGINT) AS disagreements" for name in PARITY),
    "query_texts": """SELECT * FROM (VALUES
  ('a <~1> b', '(''a'' & ''b'')', '(''a'' <0> ''b'' | ''b'' <0> ''a'' | ''a'' <1> ''b'' | ''b'' <1> ''a'')', NULL),
  ('"quick fox" & !slow', '(''quick'' <-> ''fox'')', NULL, NULL),
  ('appl* <-> pie', '(''appl'':* <-> ''pie'')', '(''appl'':* <-> ''pie'')', '(''appl'':* <-> ''pie'')'),
  ('(a | b) <2> c', '((''a'' <2> ''c'') | (''b'' <2> ''c''))', '((''a'' <2> ''c'') | (''b'' <2> ''c''))', '((''a'' <2> ''c'') | (''b'' <2> ''c''))'),
  ('x <!~3> y', '''x''', NULL, NULL),
  ('te?t & (p | q)', '(''te'':* & (''p'' | ''q''))', NULL, NULL)) AS t(query, skeleton, native, exact)""",
}
