"""Search with the query language: over document vectors, and over the postings index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.functions.text import CONFIGS, generation
from spanfold.operators.exprs import DEEPEST_EXPRESSION, Sql, belongs, either, from_map, in_map
from spanfold.plans import evaluate
from spanfold.plans.lang import All, Any, Apart, Leaf, Near, Node, Not, Phrase, QueryError, check_regexes, compile_query, deep, height, leaves, walk
from spanfold.plans.resolve import Resolved, Resolver
from spanfold.plans.select import KEYLESS, droppable, query_exact


@dataclass(frozen=True)
class Operand:
    """A query with the name of the configuration or analyzer that reads it."""

    source: str
    query: str


@dataclass(frozen=True)
class Compiled:
    """A query ready to run: its tree, its leaves, and what each stands for."""

    tree: Node
    resolver: Resolver
    leaves: tuple[Leaf, ...]
    found: dict[Leaf, Resolved]

    @property
    def height(self) -> int:
        return height(self.tree)

    @property
    def true_of_nothing(self) -> bool:
        """Whether a document that has none of the leaves matches."""
        return evaluate.matches(self.tree, lambda leaf: [])

    @property
    def only_presence(self) -> bool:
        """Whether positions play no part."""
        return not any(isinstance(n, (Phrase, Near, Apart)) for n in walk(self.tree))


def compiled(query: str, source: str | None = None) -> Compiled:
    """A query ready to run. What was made under a name that has been registered anew is not used again."""
    return _compiled(query, source, generation())


@lru_cache(maxsize=256)
def _compiled(query: str, source: str | None, registered: int) -> Compiled:
    tree = compile_query(query)
    check_regexes(tree)
    resolver = Resolver.of(source).with_words_of(query)
    found = leaves(tree)
    return Compiled(tree, resolver, tuple(found), {x: resolver.leaf(x) for x in found})


def _split(query: str | Operand, source: str | None) -> tuple[str, str | None]:
    return (query.query, query.source) if isinstance(query, Operand) else (query, source)


# --- over vectors


def _over_map(c: Compiled, tsv: str, presence: bool = False) -> Column:
    if c.height > DEEPEST_EXPRESSION:
        arrays = F.array(*(F.expr(from_map(c.found[x], tsv)) for x in c.leaves)) if c.leaves else F.array()
        return F.when(F.col(tsv).isNotNull(), _deep(c)(arrays))
    names = {x: f"z.l{i}" for i, x in enumerate(c.leaves)}
    flags = {x: f"z.p{i}" for i, x in enumerate(c.leaves)}
    with deep():
        body = Sql(names.__getitem__, flags.__getitem__ if presence else None).true(c.tree)
    fields = [f"'l{i}', {from_map(c.found[x], tsv)}" for i, x in enumerate(c.leaves)]
    if presence:
        fields += [f"'p{i}', {in_map(c.found[x], tsv)}" for i, x in enumerate(c.leaves)]
    return F.expr(f"if({tsv} IS NULL, NULL, transform(array(named_struct({', '.join(fields)})), z -> {body})[0])")


def _deep(c: Compiled) -> Callable[[Column], Column]:
    """The plain evaluator, on Arrow batches, for trees too deep for Catalyst."""
    tree, names = c.tree, c.leaves

    @F.arrow_udf("boolean")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            made = []
            for row in rows.to_pylist():
                at = None if row is None else dict(zip(names, row))
                made.append(None if at is None else evaluate.matches(tree, at.__getitem__))
            yield pa.array(made, pa.bool_())

    return judge


def recheck(query: str | Operand, source: str | None = None, tsv: str = "tsv") -> Column:
    """Whether a vector matches, positions and all. Null for a null vector."""
    return _over_map(compiled(*_split(query, source)), tsv)


#: The operator form: a query against a vector, decided by positions.
match = recheck


def selection(query: str, source: str | None = None) -> Compiled | None:
    """What an index decides of a query (see _selection)."""
    return _selection(query, source, generation())


@lru_cache(maxsize=256)
def _selection(query: str, source: str | None, registered: int) -> Compiled | None:
    """What an index decides: presence of lexemes, and phrases of them; none for a query without a key.

    A configuration reads every key again, so that a compound becomes the phrase of its parts; an analyzer's keys are taken as
    they are, and its phrases as conjunctions.
    """
    resolver = Resolver.of(source).with_words_of(query)
    config = CONFIGS["simple"] if resolver.source is None else resolver.source

    def key(leaf: Leaf) -> Node | None:
        if leaf.kind in ("prefix", "glob"):
            head = leaf.text if leaf.kind == "prefix" else leaf.key
            return Leaf("prefix", resolver.folded(head)) if head else None
        if leaf.kind == "regex":
            return None
        if resolver.analyzer:
            parts = tuple(Leaf("exact", v) for v in resolver.leaf(leaf).values)
            return None if not parts else parts[0] if len(parts) == 1 else Any(parts)
        tokens = config.tokens(leaf.text)
        if not tokens:
            return None
        parts = tuple(Leaf("exact", x) for x, _ in tokens)
        return parts[0] if len(parts) == 1 else Phrase(parts, tuple(b - a for (_, a), (_, b) in zip(tokens, tokens[1:])))

    def both(parts: list[Node | None]) -> Node | None:
        there = tuple(p for p in parts if p is not None)
        return None if not there else there[0] if len(there) == 1 else All(there)

    def lower(node: Node) -> Node | None:
        if isinstance(node, Leaf):
            return key(node)
        if isinstance(node, Phrase):
            parts = [key(a) for a in node.atoms]
            if resolver.analyzer or not all(isinstance(p, Leaf) for p in parts):
                return both(parts)
            return Phrase(tuple(parts), node.gaps)
        if isinstance(node, Apart):
            return lower(node.a)
        if isinstance(node, (Near, All)):
            return both([lower(p) for p in ((node.a, node.b) if isinstance(node, Near) else node.parts)])
        if isinstance(node, Any):
            parts = [lower(p) for p in node.parts]
            return None if None in parts else Any(tuple(parts))
        return None

    with deep():
        tree = lower(compiled(query, source).tree)
        if tree is None:
            return None
        found = leaves(tree)
    return Compiled(tree, Resolver(), tuple(found), {x: Resolver().leaf(x) for x in found})


def select(query: str | Operand, source: str | None = None, tsv: str = "tsv") -> Column:
    """Whether a vector is a candidate. A query that no lexeme can select raises."""
    chosen = selection(*_split(query, source))
    if chosen is None:
        raise QueryError(KEYLESS)
    return _over_map(chosen, tsv, presence=True)


def search(query: str | Operand, source: str | None = None, tsv: str = "tsv") -> Column:
    """Selection and, unless selection alone decides, recheck. A query that no lexeme can select raises."""
    text, name = _split(query, source)
    chosen = select(text, name, tsv)
    analyzer = Resolver.of(name).analyzer
    decided = not analyzer and (query_exact(text) is not None if name is None else droppable(text, name))
    return chosen if decided else chosen & recheck(text, name, tsv)


# --- over postings


def hits(postings: DataFrame, c: Compiled) -> DataFrame:
    """Postings of any of the query's lexemes; the condition is one that a Parquet scan prunes by."""
    return postings.where(F.expr(either([belongs(c.found[x], "lexeme") for x in c.leaves])))


def gathered(postings: DataFrame, c: Compiled, id_col: str = "doc_id", presence: bool | None = None) -> DataFrame:
    """One row a document that has a lexeme of the query: l0, l1, ... the positions of each leaf, or with presence (the default where positions play
    no part) flags, for which no positions are read.

    Over a stored index, whose buckets hold whole documents, nothing is exchanged; over other postings the matching ones are, once.
    """
    tests = [belongs(c.found[x], "lexeme") for x in c.leaves]
    if c.only_presence if presence is None else presence:
        return hits(postings, c).groupBy(id_col).agg(*(F.expr(f"max({t})").alias(f"l{i}") for i, t in enumerate(tests)))
    rows = hits(postings, c).groupBy(id_col).agg(*(F.expr(f"collect_list(CASE WHEN {t} THEN positions END)").alias(f"l{i}") for i, t in enumerate(tests)))
    # the positions of a single posting are in order already
    return rows.select(id_col, *(F.expr(f"if(size(l{i}) = 1, l{i}[0], array_sort(array_distinct(flatten(l{i}))))").alias(f"l{i}") for i in range(len(tests))))


def needed(node: Node) -> list[list[Leaf]]:
    """Groups of leaves of which a matching document has at least one each: the skeleton of the query."""
    if isinstance(node, Leaf):
        return [[node]]
    if isinstance(node, Phrase):
        return [[a] for a in node.atoms]
    if isinstance(node, Apart):
        return needed(node.a)
    if isinstance(node, (Near, All)):
        return [g for part in ((node.a, node.b) if isinstance(node, Near) else node.parts) for g in needed(part)]
    if isinstance(node, Any):
        groups = [needed(part) for part in node.parts]
        return [] if [] in groups else [[x for g in groups for x in min(g, key=len)]]
    return []


def _matching(postings: DataFrame, c: Compiled, id_col: str, ids: DataFrame | None, presence: bool) -> DataFrame:
    """Rows of gathered() that match. Those without the leaves that the skeleton asks for go before positions are compared."""
    rows = gathered(postings, c, id_col, presence)
    names = {x: f"l{i}" for i, x in enumerate(c.leaves)}
    if c.true_of_nothing:
        if ids is None:
            raise QueryError("this query also holds of documents that have none of its terms; give the table of all ids")
        nothing = F.lit(False) if presence else F.expr("cast(array() AS array<int>)")
        rows = ids.select(id_col).distinct().join(rows, id_col, "left").select(id_col, *(F.coalesce(n, nothing).alias(n) for n in names.values()))
    if c.height > DEEPEST_EXPRESSION:
        empty = F.expr("cast(array() AS array<int>)")
        made = [F.when(F.col(n), F.array(F.lit(1))).otherwise(empty) if presence else F.col(n) for n in names.values()]
        return rows.where(_deep(c)(F.array(*made)))
    with deep():
        sql = Sql(names.__getitem__, names.__getitem__ if presence else None)
        if not presence and not c.only_presence:
            rows = rows.where(" AND ".join(["true", *("(" + either([f"size({names[x]}) > 0" for x in dict.fromkeys(g)]) + ")" for g in needed(c.tree))]))
        return rows.where(F.expr(sql.true(c.tree)))


def search_postings(postings: DataFrame, query: str | Operand, source: str | None = None, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents that match, from the index.

    A query that holds of documents without any of its lexemes (a negation at the top) needs `ids`, those of all documents that have a text.
    """
    c = compiled(*_split(query, source))
    return _matching(postings, c, id_col, ids, c.only_presence).select(id_col)


# --- ranking


def cover_density(lists: list[list[int]]) -> float:
    """Sum over the shortest stretches that hold all terms of 0.1 / (1 + words in it that are none of the terms)."""
    if not lists or not all(lists):
        return 0.0
    events = sorted((p, i) for i, positions in enumerate(lists) for p in positions)
    counts, missing, left, total = [0] * len(lists), len(lists), 0, 0.0
    for right, (end, i) in enumerate(events):
        missing -= counts[i] == 0
        counts[i] += 1
        shrunk = False
        while missing == 0:
            start, j = events[left]
            counts[j] -= 1
            if counts[j] == 0:
                missing += 1
                shrunk = True
            left += 1
        if shrunk:
            inside = len({p for p, _ in events[left - 1 : right + 1]})
            total += 0.1 / (1 + max(0, end - start - (inside - 1)))
    return total


def rank(postings: DataFrame, query: str | Operand, source: str | None = None, k: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, rank) of the matching documents by cover density of the query's terms, the best k if k is given. Postings are gathered once, for both."""
    c = compiled(*_split(query, source))

    @F.arrow_udf("double")
    def density(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array((cover_density(r) for r in rows.to_pylist()), pa.float64())

    found = _matching(postings, c, id_col, None, False)
    ranked = found.select(id_col, density(F.array(*(f"l{i}" for i in range(len(c.leaves))))).alias("rank"))
    return ranked if k is None else ranked.orderBy(F.desc("rank"), id_col).limit(k)


__all__ = ["Compiled", "Node", "Not", "Operand", "compiled", "match", "rank", "recheck", "search", "search_postings", "select", "selection"]
