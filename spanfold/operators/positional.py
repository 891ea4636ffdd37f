"""Positional predicates on a column of document vectors (a map from lexeme to ascending positions).

Every function gives null for a null vector. Lexemes are compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanfold.operators.exprs import NOTHING, Sql, from_map, literal
from spanfold.plans.evaluate import LAST
from spanfold.plans.resolve import Resolved


def _checked(tsv: str, made: str) -> Column:
    return F.expr(f"if({tsv} IS NULL, NULL, {made})")


def _one(tsv: str, lexeme: str) -> str:
    return from_map(Resolved("lexemes", (lexeme,)), tsv)


def positions(lexeme: str, tsv: str = "tsv") -> Column:
    """Positions of a lexeme; none if it is absent."""
    return _checked(tsv, _one(tsv, lexeme))


def positions_prefix(prefix: str, tsv: str = "tsv") -> Column:
    """Positions of all lexemes that begin so, merged."""
    return _checked(tsv, from_map(Resolved("prefix", (prefix,)), tsv))


def positions_matching(pattern: str, kind: str = "glob", tsv: str = "tsv") -> Column:
    """Positions of all lexemes that a glob or a regex covers whole, merged."""
    return _checked(tsv, from_map(Resolved(kind, (pattern,)), tsv))


def all_lexemes(tsv: str = "tsv") -> Column:
    return F.map_keys(tsv)


def length(tsv: str = "tsv") -> Column:
    """How many lexemes a vector has."""
    return F.expr(f"if({tsv} IS NULL, NULL, size(map_keys({tsv})))")


def within(a: str, b: str, n: int, tsv: str = "tsv") -> Column:
    """Whether some a and b are at most n apart, in either order."""
    return _checked(tsv, Sql(str).within(_one(tsv, a), _one(tsv, b), n, False))


def pre(a: str, b: str, n: int, tsv: str = "tsv") -> Column:
    """Whether some b stands with some a or at most n after it."""
    return _checked(tsv, Sql(str).within(_one(tsv, a), _one(tsv, b), n, True))


def not_within(a: str, b: str, n: int, tsv: str = "tsv") -> Column:
    """Whether some a has no b within n. True for any a where a b is at the last position, whose true place is unknown."""
    sql = Sql(str)
    made = sql.bound([_one(tsv, a), _one(tsv, b)], lambda a, b: f"size({a}) > 0 AND (array_contains({b}, {LAST}) OR {sql.lone(a, b, -n, n)})")
    return _checked(tsv, made)


def chain(terms: list[str], gaps: list[int], tsv: str = "tsv") -> Column:
    """Whether occurrences lead from the first term to the last, each at most its gap from the one before, either way."""
    if not terms or len(gaps) != len(terms) - 1:
        raise ValueError("a chain needs a term and one gap fewer than terms")
    sql = Sql(str)
    reach = _one(tsv, terms[0])
    if not gaps:
        return _checked(tsv, f"size({reach}) > 0")
    for term, gap in zip(terms[1:-1], gaps[:-1]):
        reach = sql.bound([reach, _one(tsv, term)], lambda r, c, gap=gap: f"filter({c}, x -> exists({r}, y -> abs(x - y) <= {gap}))")
    return _checked(tsv, sql.within(reach, _one(tsv, terms[-1]), gaps[-1], False))


__all__ = ["NOTHING", "all_lexemes", "chain", "length", "literal", "not_within", "positions", "positions_matching", "positions_prefix", "pre", "within"]
