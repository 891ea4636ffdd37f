"""A query's meaning in plain Python, for deep trees, tests and single documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Mapping

import regex

from spanfold.plans.lang import All, Any, Apart, Leaf, Near, Node, Not, Phrase, deep, python_regex

#: The last position; what lies beyond is counted there.
LAST = 16_383
Vector = Mapping[str, list[int]]


def merged(lists: Iterable[Iterable[int]]) -> list[int]:
    return sorted({p for positions in lists for p in positions})


def glob_regex(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else regex.escape(c) for c in glob)


def test_of(kind: str, text: str) -> Callable[[str], bool]:
    """Whether a lexeme belongs to a leaf that stands for many."""
    if kind == "prefix":
        return lambda lexeme: lexeme.startswith(text)
    pattern = regex.compile(glob_regex(text) if kind == "glob" else python_regex(text), regex.S if kind == "glob" else 0)
    return lambda lexeme: pattern.fullmatch(lexeme) is not None


def leaf_positions(vector: Vector, kind: str, values: Iterable[str]) -> list[int]:
    """Positions of a resolved leaf: of any of its lexemes, or of all that its prefix, glob or regex covers."""
    if kind == "lexemes":
        return merged(vector.get(v, ()) for v in values)
    tests = [test_of(kind, v) for v in values]
    return merged(p for lexeme, p in vector.items() if any(t(lexeme) for t in tests))


def within(a: list[int], b: list[int], n: int) -> bool:
    return any((k := bisect_left(b, x - n)) < len(b) and b[k] <= x + n for x in a)


def precedes(a: list[int], b: list[int], n: int) -> bool:
    return any((k := bisect_left(b, x)) < len(b) and b[k] <= x + n for x in a)


def not_within(a: list[int], b: list[int], n: int) -> bool:
    if not a or not b:
        return bool(a)
    return b[-1] == LAST or any((k := bisect_left(b, x - n)) == len(b) or b[k] > x + n for x in a)


def chain(lists: list[list[int]], gaps: list[int]) -> bool:
    """Whether occurrences lead from the first list to the last, each step of at most its gap either way."""
    if not lists or len(gaps) != len(lists) - 1:
        raise ValueError("a chain needs a term and one gap fewer than terms")
    reach = lists[0]
    for now, gap in zip(lists[1:], gaps):
        reach = [p for p in now if within([p], reach, gap)]
    return bool(reach)


def near(a: tuple[int, int], b: tuple[int, int], n: int, ordered: bool) -> bool:
    """Edge to edge, for whole occurrences."""
    return 0 <= b[0] - a[1] <= n if ordered else b[0] - a[1] <= n and a[0] - b[1] <= n


def spanned(intervals: Iterable[tuple[int, int]]) -> list[int]:
    return merged(range(s, e + 1) for s, e in intervals)


class Evaluator:
    """Evaluates over one document, given the positions of leaves."""

    def __init__(self, positions_of: Callable[[Leaf], list[int]]) -> None:
        self.leaf = positions_of

    def ends(self, phrase: Phrase) -> list[int]:
        reach = self.leaf(phrase.atoms[0])
        for atom, gap in zip(phrase.atoms[1:], phrase.gaps):
            before = set(reach)
            reach = [p for p in self.leaf(atom) if p - gap in before]
        return reach

    def positions(self, node: Node) -> list[int]:
        if isinstance(node, Leaf):
            return self.leaf(node)
        if isinstance(node, Phrase):
            total = sum(node.gaps)
            return spanned((e - total, e) for e in self.ends(node))
        if isinstance(node, Any):
            return merged(map(self.positions, node.parts))
        if isinstance(node, Near):
            a, b = self.positions(node.a), self.positions(node.b)
            out = []
            for p in a:
                lo, hi = bisect_left(b, p if node.ordered else p - node.n), bisect_right(b, p + node.n)
                if lo < hi:
                    out.append((min(p, b[lo]), max(p, b[hi - 1])))
            return spanned(out)
        return spanned(self.occurrences(node))

    def occurrences(self, node: Node) -> list[tuple[int, int]]:
        if isinstance(node, Leaf):
            return [(p, p) for p in self.leaf(node)]
        if isinstance(node, Phrase):
            total = sum(node.gaps)
            return [(e - total, e) for e in self.ends(node)]
        if isinstance(node, Any):
            return sorted({o for part in node.parts for o in self.occurrences(part)})
        a, b = self.occurrences(node.a), self.occurrences(node.b)
        if isinstance(node, Near):
            return sorted({(min(x[0], y[0]), max(x[1], y[1])) for x in a for y in b if near(x, y, node.n, node.ordered)})
        if any(y[1] == LAST for y in b):
            return a
        return [x for x in a if not any(near(x, y, node.n, node.ordered) for y in b)]

    def true(self, node: Node) -> bool:
        if isinstance(node, All):
            return all(map(self.true, node.parts))
        if isinstance(node, Any):
            return any(map(self.true, node.parts))
        if isinstance(node, Not):
            return not self.true(node.part)
        if isinstance(node, Near):
            return (precedes if node.ordered else within)(self.positions(node.a), self.positions(node.b), node.n)
        if isinstance(node, Apart):
            return bool(self.occurrences(node))
        return bool(self.positions(node))


def matches(node: Node, positions_of: Callable[[Leaf], list[int]]) -> bool:
    with deep():
        return Evaluator(positions_of).true(node)
