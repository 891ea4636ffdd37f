"""Small tables of cases for what SQL can't compute: each is evaluated by Spark, or compiled on the driver, and stands beside what it must give.

A case of kind `vector` gives the vector of a text under a configuration or analyzer; `match` whether a text matches a query (`select`: whether the
index would propose it); `told` what a function on the driver says. What raises gives `error`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfold.functions.text import Analyzer, is_analyzer, register, source, vector_text
from spanfold.operators.search import Operand, compiled, needed, recheck, select
from spanfold.plans.lang import Leaf, QueryError, compile_query
from spanfold.plans.resolve import Resolver
from spanfold.plans.select import droppable, query_exact, query_native, query_skeleton
from spanfold.sources.index import vectors

#: An analyzer with dictionary words, as an index of texts in unspaced scripts has one.
WORDS = Analyzer("icu_cases", words={"天气很好": ("天气", "很好")})

VECTORS: dict[str, list[tuple[str, str, str]]] = {
    "tok_word": [("icu", "Blue sky_line 42", "42:3 blue:1 sky_line:2"), ("icu", "x y x", "x:1,3 y:2"), ("icu", "", "")],
    "tok_casefold": [("icu", "GROSS groß", "gross:1,2"), ("icu", "ΣΑΣ", "σασ:1")],
    "tok_accent": [("icu", "Crème brûlée", "brulee:2 brûlée:2 creme:1 crème:1"), ("icu", "Łódź", "lodz:1 łódź:1")],
    "tok_nfkc": [("icu", "ｗｉｄｅ Ⅷ", "viii:2 wide:1 ⅷ:2 ｗｉｄｅ:1")],
    "tok_join_hyphen": [("icu", "well-known fact", "fact:2 known:1 well:1 well-known:1 wellknown:1"), ("icu", "55-66", "55:1 55-66:1 5566:1 66:1"), ("icu", "left - right", "left:1 right:2")],
    "tok_join_amp": [("icu", "an M&A deal", "a:2 an:1 deal:3 m:2 m&a:2 ma:2"), ("icu", "salt & pepper", "pepper:2 salt:1")],
    "tok_email": [("icu", "to kim@post.example.net today", "example:2 kim:2 kim@post.example.net:2 post:2 post.example.net:2 to:1 today:3"), ("icu", "not@anaddress", "anaddress:2 not:1")],
    "tok_url": [("icu", "read http://docs.example.org/a?b=c again", "again:3 docs:2 docs.example.org:2 example:2 http://docs.example.org/a?b=c:2 read:1")],
    "tok_url_emit": [("icu", "HTTPS://upper.example https://one", "https:1 https://one:3 one:3 upper:2 upper.example:2")],
    "tok_bare_host": [("icu", "shop.example.com sells", "example:1 sells:2 shop:1 shop.example.com:1"), ("icu", "pi is 3.14", "3.14:3 is:2 pi:1")],
    "tok_apos": [("icu", "Kim’s don't", "don:2 don't:2 dont:2 kim:1 kim's:1 kims:1")],
    "tok_emoji": [("icu", "ok 🎉 done", "done:3 ok:1 🎉:2")],
    "tok_punct": [("icu", "wait... (what?) — no!", "no:3 wait:1 what:2")],
    "tok_emit_sub": [("icu:english_stem", "The red-hot irons", "hot:2 iron:3 red:2 red-hot:2 redhot:2")],
    "tok_segment": [("icu", "天气很好 ok", "ok:5 天:1 好:4 很:3 气:2"), ("icu_cases", "天气很好 ok", "ok:3 天气:1 很好:2")],
    "tok_norm": [("icu", "co­op zero​width é", "coop:1 e:3 zerowidth:2 é:3")],
    "tok_cfg": [("english", "the running dogs", "dog:3 run:2"), ("simple_unaccent", "Café-Bar", "bar:3 cafe:2 cafe-bar:1"), ("simple", "Café-Bar", "bar:3 café:2 café-bar:1")],
    "tok_analyzer": [("prox_icu", "Señor O'Neil", "o:2 o'neil:2 oneil:2 senor:1 señor:1"), ("unicode", "naïve", "naive:1 naïve:1")],
    "an_dict": [("icu:english_stem", "jumping foxes", "fox:2 jump:1"), ("icu:simple", "jumping foxes", "foxes:2 jumping:1")],
    "an_prox_icu": [("prox_icu", "Año 🎉", "ano:1 año:1 🎉:2")],
    "an_prox_unicode": [("prox_unicode", "Año 天气", "ano:1 año:1 天:2 气:3")],
    "an_prox_icu_accent": [("prox_icu_accent", "Año ano", "ano:2 año:1")],
    "an_prox_icu_no_emoji": [("prox_icu_no_emoji", "a 🎉 b", "a:1 b:2")],
}

#: configuration or analyzer (none: byte by byte), text, query, outcome
MATCHES: dict[str, list[tuple[str | None, str, str, str]]] = {
    "lx_ws": [(None, "one two", " \t one\n&two ", "true"), (None, "one two", "   ", "error")],
    "lx_bool": [(None, "one two", "one&!three|four", "true"), (None, "one two", "one &", "error")],
    "lx_bracket": [(None, "one two", "((one))", "true"), (None, "one two", "(one", "error"), (None, "one two", "one)", "error")],
    "lx_op": [(None, "one two", "one <-> two", "true"), (None, "one two", "one <?> two", "error"), (None, "one two", "one <~1 two", "error"), (None, "one two", "one <!1> two", "error")],
    "lx_dist": [(None, "one x two", "one <002> two", "true"), (None, "one two", "one <16385> two", "error"), (None, "one two", "one <~16384> two", "true"), (None, "one two", "one <~> two", "error")],
    "lx_phrase": [(None, "one two", '"one  two"', "true"), (None, "one two", '"one', "error"), (None, "one two", '" "', "error"), (None, "one two", '"two one"', "false")],
    "lx_literal": [(None, "one* two", "'one*'", "false"), (None, "one two", "'one'", "true"), (None, "one two", "''", "error"), (None, "one two", "'one", "error")],
    "lx_regex": [(None, "ab12 x", "##[a-z]{2}[0-9]+##", "true"), (None, "ab12 x", "##ab##", "false"), (None, "x", "##x", "error"), (None, "x", "#x", "error")],
    "lx_word": [(None, "one two", "ONE", "true"), (None, "École", "École", "false")],
    "lx_prefix": [(None, "magnet", "mag*", "true"), (None, "magnet", "mag:*", "true"), (None, "magnet", "mat*", "false"), (None, "magnet", "*", "error")],
    "lx_glob": [(None, "magnet", "m?g*t", "true"), (None, "magnet", "*nets", "false"), (None, "a", "??", "false")],
    "ps_or": [(None, "one", "two | one", "true"), (None, "one", "two | three", "false")],
    "ps_and": [(None, "one two", "two & one", "true"), (None, "one", "one & two", "false"), (None, "one", "one | two & three", "true")],
    "ps_prox": [(None, "a b c", "a <~1> b & c", "true"), (None, "a x b c", "a <~1> b | c <-0> c", "true"), (None, "a b", "a <~1> <~1> b", "error")],
    "ps_unary": [(None, "a b", "!c & a", "true"), (None, "a b", "!!a", "true"), (None, "a b", "!a", "false")],
    "ps_atom": [(None, "a b", "(a)", "true"), (None, "a b", "& a", "error"), (None, "a b", "a b", "error")],
    "ps_leftassoc": [(None, "a x x b x x c", "a <~3> b <~3> c", "true"), (None, "a x x b x x x c", "a <~3> b <~3> c", "false")],
    "ps_phrase_collapse": [(None, "a b c", 'a <-> "b c"', "true"), (None, "a b x c", '"a b" <2> c', "true"), (None, "a b c", '("a" | b) <-> c', "true")],
    "ps_depth_cap": [(None, "a", "(" * 1000 + "a" + ")" * 1000, "true"), (None, "a", "(" * 1025 + "a" + ")" * 1025, "error"), (None, "a", "!" * 1025 + "a", "error")],
    "ps_expand_cap": [(None, "a", "(" + "|".join("abcdefghij" * 10) + ") <-> (" + "|".join("abcdefghij" * 10) + ")", "error"), (None, "a b", "(a | c) <-> (b | d)", "true")],
    "nm_flatten": [(None, "a b c", "a & (b & (c))", "true"), (None, "c", "a | (b | (c))", "true")],
    "nm_positional": [(None, "a b c", "(a & b) <~2> c", "error"), (None, "a b c", "a <~2> (b <~1> !c)", "error"), (None, "a b c", "(a | b) <~2> c", "true"), (None, "a b c", "(a & b) <-> c", "error")],
    "rx_validate": [(None, "a", "##(##", "error"), (None, "a", "z & ##[##", "error"), (None, "a", "##(?P<n>a)##", "error"), (None, "a", "##[[:alpha:]]##", "true"), (None, "a", "##[[:none:]]##", "error")],
    "recheck_cfg": [("english", "the runner was running", "runs <~2> the", "false"), ("english", "the runner was running", "runs", "true"), ("english", "the end", "the", "false"), ("simple_unaccent", "un thé vert", "the <-> VERT", "true")],
    "recheck_analyzer": [("icu", "un thé vert", "the <-> vert", "true"), ("icu", "un the vert", "'thé'", "false"), ("icu", "at kim@post.example.net", "at <-> post", "true"), ("nothing", "a", "a", "error")],
    "recheck_operand": [("icu:english_stem", "two red-hot irons", '"redhot iron"', "true"), ("english", "she jumped fences", "jumps <~1> fence", "true")],
    "resolve_cfg": [("english", "many ponies", "pony", "true"), ("english", "many ponies", "ponies & of", "false")],
    "resolve_prefix": [("simple_unaccent", "cafétéria", "CAFÉ*", "true"), ("simple", "cafeteria", "café*", "false"), ("simple", "a.b.c d", "a.b*", "true")],
    "resolve_glob": [("simple_unaccent", "élève", "É*Ve", "true"), ("simple", "élève", "É*VE", "true"), ("simple", "eleve", "é*", "false")],
}
SELECTED: dict[str, list[tuple[str | None, str, str, str]]] = {
    "skel_operand": [("english", "shoes for running", "running <-1> shoes", "true"), ("english", "walking shoes", "running <~9> shoes", "false"), ("icu", "vert et thé", '"the vert"', "true")],
    "skel_analyzer": [("icu", "well-known", "wellknown <~3> known", "true"), ("icu", "a b", "*b", "error"), ("icu", "a b", "!b", "error")],
}


def _skeleton_of(query: str) -> str:
    """The groups of leaves that a search over the index asks for before it compares positions."""
    return " & ".join("|".join(x.text for x in group) for group in needed(compiled(query).tree))


def _resolved(name: str, kind: str, text: str) -> str:
    return ",".join(Resolver.of(name).leaf(Leaf(kind, text)).values)


TOLD: dict[str, list[tuple[Callable[[], object], str]]] = {
    "an_parse": [(lambda: Analyzer.named("prox_icu").name, "prox_icu"), (lambda: Analyzer.named(" unicode : english_stem ").dictionary is not None, "true"), (lambda: Analyzer.named("icu:other"), "none"), (lambda: source("other"), "error")],
    "is_analyzer": [(lambda: is_analyzer("icu"), "true"), (lambda: is_analyzer("prox_icu_accent:english_stem"), "true"), (lambda: is_analyzer("english"), "false"), (lambda: is_analyzer("ICU"), "false")],
    "tok_text": [(lambda: vector_text(source("icu").tokens("it's so")), "'it''s':1 'it':1 'its':1 'so':2"), (lambda: vector_text(source("simple").tokens("a-b")), "'a-b':1 'a':2 'b':3")],
    "resolve_bare": [(lambda: _resolved("icu", "term", "Crème"), "creme"), (lambda: _resolved("icu", "term", "Red-Hot"), "red-hot"), (lambda: _resolved("icu", "term", "a/b"), "a,b"), (lambda: _resolved("english", "term", "the"), "")],
    "resolve_exact": [(lambda: _resolved("icu", "exact", "Crème"), "crème"), (lambda: _resolved("english", "exact", "Dogs"), "dog")],
    "mk_operand": [(lambda: Operand("english", "a <~2> b").source, "english"), (lambda: Operand("icu", "x") == Operand("icu", "x"), "true"), (lambda: recheck(Operand("icu", "x <")), "error")],
    "support": [(lambda: _skeleton_of("p <~3> q"), "p & q"), (lambda: _skeleton_of("(p | q) & !r & s*"), "p|q & s"), (lambda: _skeleton_of("p <!~3> q"), "p"), (lambda: _skeleton_of("!p"), ""), (lambda: _skeleton_of('"p q" | r'), "p|r")],
    "exact_cfg": [(lambda: droppable("running & shoes", "english"), "true"), (lambda: droppable("the & shoes", "english"), "false"), (lambda: droppable("a <~2> b", "english"), "false"), (lambda: droppable('"un café"', "simple_unaccent"), "true")],
    "exact_text": [(lambda: query_exact("p & q*"), "('p' & 'q':*)"), (lambda: query_exact("p <~1> q"), "none")],
    "native_text": [(lambda: query_native("p <-1> q"), "('p' <0> 'q' | 'p' <1> 'q')"), (lambda: query_native("p <~33> q"), "none"), (lambda: query_native("p & (q"), "none")],
    "skel_text": [(lambda: query_skeleton("(p <~3> q) & !r"), "('p' & 'q')"), (lambda: query_skeleton("##x##"), "error"), (lambda: query_skeleton('"crème brûlée"', "icu"), "('creme' & 'brulee')")],
    "ast_cache": [(lambda: compiled("p <~2> q") is compiled("p <~2> q"), "true"), (lambda: compile_query("p <~2> q") == compiled("p <~2> q").tree, "true")],
}


def _shown(value: object) -> str:
    return "none" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _cases(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "case int, result string")


def vector_cases(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(WORDS)
        made = None
        for kind in dict.fromkeys(k for k, _, _ in VECTORS[name]):
            texts = [(n, text) for n, (k, text, _) in enumerate(VECTORS[name]) if k == kind]
            held = vectors(spark.createDataFrame(texts, "doc_id int, text string"), kind)
            entry = F.array_join(F.transform(F.array_sort(F.map_keys("tsv")), lambda k: F.concat(k, F.lit(":"), F.array_join(F.transform(F.element_at("tsv", k), lambda p: p.cast("string")), ","))), " ")
            part = held.select(F.col("doc_id").alias("case"), entry.alias("result"))
            made = part if made is None else made.unionAll(part)
        return made

    return run


def match_cases(rows: list[tuple[str | None, str, str, str]], test=recheck) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        failed, held = [], {}
        for n, (name, text, query, _) in enumerate(rows):
            try:
                condition = test(query if name is None else Operand(name, query))
            except QueryError:
                failed.append((n, "error"))
            else:
                held.setdefault(name, []).append((n, text, condition))
        made = _cases(spark, failed)
        for name, some in held.items():
            docs = vectors(spark.createDataFrame([(n, text) for n, text, _ in some], "doc_id int, text string"), name or "simple")
            outcome = F.coalesce(*(F.when(F.col("doc_id") == n, condition.cast("string")) for n, _, condition in some))
            made = made.unionAll(docs.select(F.col("doc_id").alias("case"), outcome.alias("result")))
        return made

    return run


def told_cases(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for n, (ask, _) in enumerate(TOLD[name]):
            try:
                rows.append((n, _shown(ask())))
            except QueryError:
                rows.append((n, "error"))
        return _cases(spark, rows)

    return run


def literal_rows(outcomes: list[str]) -> str:
    """SQL of the rows (case, result)."""
    values = ", ".join("({}, '{}')".format(n, x.replace("'", "''")) for n, x in enumerate(outcomes))
    return f"SELECT CAST(c AS INTEGER) AS \"case\", r AS result FROM (VALUES {values}) AS t(c, r)"


QUERIES = {name: vector_cases(name) for name in VECTORS} | {name: match_cases(rows) for name, rows in MATCHES.items()} | {name: match_cases(rows, select) for name, rows in SELECTED.items()} | {name: told_cases(name) for name in TOLD}
ORACLE_SQL = {name: literal_rows([x[-1] for x in rows]) for table in (VECTORS, MATCHES, SELECTED, TOLD) for name, rows in table.items()}
