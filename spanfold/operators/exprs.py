"""Query trees as Catalyst expressions over arrays of positions.

Positions of leaves are columns or expressions; everything else is composed of higher-order functions. A value that a
lambda's body needs more than once is bound first, by a transform over an array of one struct, because Catalyst would evaluate it
again for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from spanfold.plans.evaluate import LAST
from spanfold.plans.lang import All, Any, Apart, Leaf, Near, Node, Not, Phrase
from spanfold.plans.resolve import Resolved

NOTHING = "cast(array() AS array<int>)"
#: Levels of a tree beyond which Catalyst's recursion is not trusted and the plain evaluator takes over.
DEEPEST_EXPRESSION = 40
#: Pairs of positions up to which all are compared, instead of merging the two arrays.
PAIRWISE = 1_024


def literal(text: str) -> str:
    """A SQL string; what could be read as an escape is written as a code point."""
    return "'" + "".join(c if c.isalnum() or c in " -_.:;,/@&<>()[]{}^$|+*?!=~%#" else "".join(f"\\u{u:04x}" for u in _units(c)) for c in text) + "'"


def _units(c: str) -> list[int]:
    code = ord(c)
    return [code] if code < 0x10000 else [0xD800 + ((code - 0x10000) >> 10), 0xDC00 + ((code - 0x10000) & 0x3FF)]


def glob_like(glob: str) -> str:
    """A glob as a LIKE pattern with `^` as escape."""
    return "".join("%" if c == "*" else "_" if c == "?" else f"^{c}" if c in "%_^" else c for c in glob)


def belongs(found: Resolved, lexeme: str) -> str:
    """Whether the lexeme (an expression) is one of a resolved leaf's. Prefixes come as conditions that a Parquet scan can use."""
    from spanfold.plans.lang import java_regex, literal_head

    if not found.values:
        return "false"
    if found.kind == "lexemes":
        if len(found.values) == 1:
            return f"{lexeme} = {literal(found.values[0])}"
        return f"{lexeme} IN ({', '.join(map(literal, found.values))})"
    text = found.values[0]
    if found.kind == "prefix":
        return f"startswith({lexeme}, {literal(text)})"
    if found.kind == "regex":
        return f"{lexeme} RLIKE {literal(java_regex(text))}"
    head = literal_head(text)
    narrowed = f"startswith({lexeme}, {literal(head)}) AND " if head else ""
    return f"({narrowed}{lexeme} LIKE {literal(glob_like(text))} ESCAPE '^')"


def union(parts: list[str]) -> str:
    if len(parts) == 1:
        return parts[0]
    return f"array_sort(array_distinct(flatten(array({', '.join(parts)}))))"


def from_map(found: Resolved, tsv: str) -> str:
    """Positions of a resolved leaf in a map of lexemes."""
    if found.kind == "lexemes":
        return union([f"coalesce({tsv}[{literal(v)}], {NOTHING})" for v in found.values]) if found.values else NOTHING
    return f"array_sort(array_distinct(flatten(map_values(map_filter({tsv}, (k, p) -> {belongs(found, 'k')})))))"


def in_map(found: Resolved, tsv: str) -> str:
    """Whether the map has a lexeme of the leaf, with positions or without."""
    if found.kind == "lexemes":
        return either([f"map_contains_key({tsv}, {literal(v)})" for v in found.values]) if found.values else "false"
    return f"exists(map_keys({tsv}), k -> {belongs(found, 'k')})"


def balanced(parts: list[str], sign: str) -> str:
    """Parts joined as a tree of small depth."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return f"({balanced(parts[:half], sign)} {sign} {balanced(parts[half:], sign)})"


def either(parts: list[str]) -> str:
    return balanced(parts, "OR")


class Sql:
    """Expressions of nodes, given those of leaves."""

    def __init__(self, leaf: Callable[[Leaf], str], present: Callable[[Leaf], str] | None = None) -> None:
        self.leaf = leaf
        self.present = present or (lambda x: f"size({leaf(x)}) > 0")
        self.names = count()

    def fresh(self) -> str:
        return f"v{next(self.names)}"

    def bound(self, values: list[str], body: Callable[..., str]) -> str:
        z = self.fresh()
        fields = ", ".join(f"'f{i}', {v}" for i, v in enumerate(values))
        inner = body(*(f"{z}.f{i}" for i in range(len(values))))
        return f"transform(array(named_struct({fields})), {z} -> {inner})[0]"

    # --- points

    def tagged(self, a: str, b: str) -> str:
        """Positions of both in one ascending array: twice each position, and one more for those of b, so that at one place a stands first."""
        x, y = self.fresh(), self.fresh()
        return f"sort_array(concat(transform({a}, {x} -> 2 * {x}), transform({b}, {y} -> 2 * {y} + 1)))"

    def within(self, a: str, b: str, n: int, ordered: bool) -> str:
        """Whether an x of a and a y of b are that near.

        Short arrays are compared pair by pair until one fits. In longer ones the nearest pair stands side by side in the merged order, so the work grows with their sum.
        """

        def body(a: str, b: str) -> str:
            x, y, m, i = (self.fresh() for _ in range(4))
            test = f"{y} - {x} BETWEEN 0 AND {n}" if ordered else f"abs({x} - {y}) <= {n}"
            beside = f"{y} % 2 = 1 AND {x} % 2 = 0" if ordered else f"{x} % 2 <> {y} % 2"
            steps = f"zip_with({m}, slice({m}, 2, size({m})), ({x}, {y}) -> {y} IS NOT NULL AND {beside} AND {y} div 2 - {x} div 2 <= {n})"
            merged = f"exists(transform(array({self.tagged(a, b)}), {m} -> {steps})[0], {i} -> {i})"
            return f"if(size({a}) * size({b}) <= {PAIRWISE}, exists({a}, {x} -> exists({b}, {y} -> {test})), {merged})"

        return self.bound([a, b], body)

    def lone(self, a: str, b: str, low: int, high: int) -> str:
        """Whether an x of a has no y of b in [x + low, x + high].

        One pass over the merged order of x + low and y: the first x after a y is the one that a next y is farthest from.
        """

        def body(a: str, b: str) -> str:
            x, y, s, v = (self.fresh() for _ in range(4))
            both = self.tagged(f"transform({a}, {x} -> {x} + {low})", b)
            far = f"{v} div 2 - {s}.x > {high - low}"
            step = f"if({v} % 2 = 1, named_struct('found', {s}.found OR coalesce({far}, false), 'x', cast(null AS int)), named_struct('found', {s}.found, 'x', coalesce({s}.x, cast({v} div 2 AS int))))"
            return f"aggregate({both}, named_struct('found', false, 'x', cast(null AS int)), ({s}, {v}) -> {step}, {s} -> {s}.found OR {s}.x IS NOT NULL)"

        return self.bound([a, b], body)

    def ends(self, phrase: Phrase) -> str:
        reach = self.leaf(phrase.atoms[0])
        for atom, gap in zip(phrase.atoms[1:], phrase.gaps):
            x = self.fresh()
            reach = self.bound([reach, self.leaf(atom)], lambda r, c, x=x, gap=gap: f"filter({c}, {x} -> array_contains({r}, {x} - {gap}))")
        return reach

    def spread(self, intervals: str) -> str:
        """Every position of the intervals, once and in order."""
        x = self.fresh()
        return f"array_sort(array_distinct(flatten(transform({intervals}, {x} -> sequence({x}.s, {x}.e)))))"

    def positions(self, node: Node) -> str:
        if isinstance(node, Leaf):
            return self.leaf(node)
        if isinstance(node, Phrase):
            return self.spread(self.occurrences(node)) if sum(node.gaps) else self.ends(node)
        if isinstance(node, Any):
            return union([self.positions(p) for p in node.parts])
        if isinstance(node, Near):
            lowest = 0 if node.ordered else node.n

            def body(a: str, b: str) -> str:
                x, y, q, i = (self.fresh() for _ in range(4))
                partners = f"filter({b}, {y} -> {y} BETWEEN {x} - {lowest} AND {x} + {node.n})"
                one = f"transform(array({partners}), {q} -> named_struct('s', least({x}, array_min({q})), 'e', greatest({x}, array_max({q})), 'k', size({q})))[0]"
                return f"filter(transform({a}, {x} -> {one}), {i} -> {i}.k > 0)"

            return self.spread(self.bound([self.positions(node.a), self.positions(node.b)], body))
        return self.spread(self.occurrences(node))

    # --- whole occurrences

    def near(self, i: str, j: str, n: int, ordered: bool) -> str:
        if ordered:
            return f"({j}.s >= {i}.e AND {j}.s - {i}.e <= {n})"
        return f"({j}.s <= {i}.e + {n} AND {i}.s <= {j}.e + {n})"

    def occurrences(self, node: Node) -> str:
        if isinstance(node, Leaf):
            x = self.fresh()
            return f"transform({self.leaf(node)}, {x} -> named_struct('s', {x}, 'e', {x}))"
        if isinstance(node, Phrase):
            x = self.fresh()
            return f"transform({self.ends(node)}, {x} -> named_struct('s', {x} - {sum(node.gaps)}, 'e', {x}))"
        if isinstance(node, Any):
            return f"array_distinct(flatten(array({', '.join(self.occurrences(p) for p in node.parts)})))"

        def pairs(a: str, b: str) -> str:
            i, j, k = (self.fresh() for _ in range(3))
            cover = f"named_struct('s', least({i}.s, {k}.s), 'e', greatest({i}.e, {k}.e))"
            return f"array_distinct(flatten(transform({a}, {i} -> transform(filter({b}, {j} -> {self.near(i, j, node.n, node.ordered)}), {k} -> {cover}))))"

        def lone(a: str, b: str) -> str:
            i, j, k = (self.fresh() for _ in range(3))
            return f"if(exists({b}, {k} -> {k}.e = {LAST}), {a}, filter({a}, {i} -> NOT exists({b}, {j} -> {self.near(i, j, node.n, node.ordered)})))"

        return self.bound([self.occurrences(node.a), self.occurrences(node.b)], pairs if isinstance(node, Near) else lone)

    # --- truth

    def true(self, node: Node) -> str:
        if isinstance(node, Leaf):
            return self.present(node)
        if isinstance(node, Phrase):
            return f"size({self.ends(node)}) > 0"
        if isinstance(node, (All, Any)):
            return balanced([self.true(p) for p in node.parts], "AND" if isinstance(node, All) else "OR")
        if isinstance(node, Not):
            return f"NOT ({self.true(node.part)})"
        if isinstance(node, Near):
            return self.within(self.positions(node.a), self.positions(node.b), node.n, node.ordered)
        if isinstance(node.a, (Leaf, Phrase)) and isinstance(node.b, (Leaf, Phrase)):
            # both sides have a fixed width, so their last positions tell all
            wide, other = (sum(x.gaps) if isinstance(x, Phrase) else 0 for x in (node.a, node.b))
            low, high = (other, other + node.n) if node.ordered else (-wide - node.n, other + node.n)
            ends = [self.ends(x) if isinstance(x, Phrase) else self.leaf(x) for x in (node.a, node.b)]
            return self.bound(ends, lambda a, b: f"size({a}) > 0 AND (array_contains({b}, {LAST}) OR {self.lone(a, b, low, high)})")
        return f"size({self.occurrences(node)}) > 0"
