"""Fuzzy search for short licence notices: exact seeds find candidates, bounded-error matching verifies them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import spread_out

#: Name and wording, or wordings, of the notices that are looked for by default.
NOTICES: dict[str, str | tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)"),
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GPL-3.0": ("licensed under the GNU General Public License, version 3", "either version 3 of the License, or (at your option) any later version"),
    "GPL-2.0": ("licensed under the GNU General Public License, version 2", "either version 2 of the License, or (at your option) any later version"),
    "GPL": "GNU General Public License as published by the Free Software Foundation",
    "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License",
    "MPL-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD": ("Redistribution and use in source and binary forms, with or without modification", "licensed under the BSD 3-Clause License"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "EPL-2.0": "the terms of the Eclipse Public License v. 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0",
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "SPDX": "SPDX-License-Identifier:",
    "All-rights": "All rights reserved",
}
SCHEMA = "doc_id {id}, notice string, start int, end int, edits int, matched string"


def fold(text: str) -> str:
    """Lower case, character by character, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def allowed(notice: str, errors_a_char: float) -> int:
    """Edits that a notice may have."""
    return int(len(notice) * errors_a_char)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces and their offsets: k edits leave at least one of them whole."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Taken:
    """Spans that don't overlap, looked up by place; none is longer than width."""

    def __init__(self, width: int) -> None:
        self.width, self.held = max(1, width), defaultdict(list)

    def among(self, start: int, end: int) -> list[tuple[int, int]]:
        """Those that overlap [start, end), in order."""
        found = {x for k in range(start // self.width - 1, (end - 1) // self.width + 1) for x in self.held.get(k, ()) if x[0] < end and x[1] > start}
        return sorted(found)

    def add(self, start: int, end: int) -> None:
        self.held[start // self.width].append((start, end))


class Scanner:
    """Finds the notices in one text after another."""

    def __init__(self, notices: Mapping[str, str | tuple[str, ...]], errors_a_char: float) -> None:
        self.names, self.notes, self.limits, self.patterns = [], [], [], []
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for name, wordings in notices.items():
            for notice in (wordings,) if isinstance(wordings, str) else wordings:
                low = fold(notice)
                if not low:
                    raise ValueError(f"notice {name!r} is empty")
                k = min(allowed(low, errors_a_char), len(low) - 1)
                for at, piece in pieces(low, k):
                    seeds[piece].append((len(self.names), at))
                self.names.append(name)
                self.notes.append(low)
                self.limits.append(k)
                self.patterns.append(regex.compile(f"(?:{regex.escape(low)}){{e<={k}}}", regex.BESTMATCH))
        self.widest = max((len(n) + k for n, k in zip(self.notes, self.limits)), default=1)
        self.machine = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def best(self, low: str, i: int, start: int, end: int) -> tuple[int, int, int] | None:
        """(edits, start, -end) of the best match of notice i in low[start:end]."""
        if end - start < len(self.notes[i]) - self.limits[i]:
            return None
        at = low.find(self.notes[i], start, end)
        if at >= 0:
            return 0, at, -at - len(self.notes[i])
        found = self.patterns[i].search(low, start, end) if self.limits[i] else None
        return (sum(found.fuzzy_counts), found.start(), -found.end()) if found else None

    def spans(self, low: str, i: int, starts: set[int]) -> Iterator[tuple[int, int, int]]:
        """Matches (edits, start, -end) of notice i, the best first and none over another, given where seeds let it begin.

        Each seed has a window of its own, no longer than the notice and its edits allow, so that the work grows with the number
        of seeds. A window whose best match has lost its place is searched again in what is left of it.
        """
        n, k = len(self.notes[i]), self.limits[i]
        todo = []
        for at in starts:
            a, b = max(0, at - k), min(len(low), at + n + k)
            if found := self.best(low, i, a, b):
                todo.append((found, a, b))
        heapify(todo)
        taken = Taken(n + k)
        while todo:
            found, a, b = heappop(todo)
            _, start, end = found
            if not taken.among(start, -end):
                taken.add(start, -end)
                yield found
                continue
            left = a
            for x, y in [*taken.among(a, b), (b, b)]:
                if x > left and (again := self.best(low, i, left, x)):
                    heappush(todo, (again, left, x))
                left = max(left, y)

    def seeds(self, low: str) -> dict[int, set[int]]:
        """By notice, where it would begin for one of its seeds to stand where it does."""
        found: dict[int, set[int]] = defaultdict(set)
        for last, (size, uses) in self.machine.iter(low):
            for i, at in uses:
                found[i].add(last - size + 1 - at)
        return found

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, str]]:
        """(notice, start, end, edits, matched) by start; none for null or empty text."""
        if not text:
            return []
        low = fold(text)
        found = [(e, a, b, i) for i, starts in self.seeds(low).items() for e, a, b in self.spans(low, i, starts)]
        return [(self.names[i], a, b, e, text[a:b]) for a, b, i, e in sorted(apart(found, self.widest))]


def apart(found: list[tuple[int, int, int, int]], width: int) -> list[tuple[int, int, int, int]]:
    """Of (edits, start, -end, notice) those that overlap no better one, as (start, end, notice, edits)."""
    kept, taken = [], Taken(width)
    for e, a, b, i in sorted(found):
        if not taken.among(a, -b):
            taken.add(a, -b)
            kept.append((a, -b, i, e))
    return kept


def scan_licenses(docs: DataFrame, notices: Mapping[str, str | tuple[str, ...]] | None = None, errors_a_char: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: doc_id, notice, start, end (characters of the text), edits, matched.

    A notice of n characters may differ by int(n * errors_a_char) insertions, deletions and substitutions;
    case is ignored. A notice cut into k+1 pieces keeps one of them whole under k edits, so each text is read
    once by an Aho-Corasick machine of all pieces, and only the stretch around each hit is given to the
    bounded-error matcher, so that the work grows with the number of hits, however often a notice is repeated. A notice's best match is taken first
    (then the leftmost), and what is left of the stretches beside it is searched again. Of matches that overlap, of one notice or several, the one
    with the fewest edits is reported, then the leftmost, the longest, the notice listed first. A notice may have several wordings.

    Narrow and stateless: one pass over id and text, no exchange. Null or empty texts give no rows, very long
    ones are read whole. Null ids are reported as null; repeated rows are reported once each. Only the two
    columns are read, so other columns of any name do not matter. No rows give no rows.
    """
    known = dict(NOTICES if notices is None else notices)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, errors_a_char)
        for batch in batches:
            ids, rows, columns = batch.column(0), [], [[] for _ in range(5)]
            for n, text in enumerate(batch.column(1)):
                for hit in scanner.scan(text.as_py()):
                    rows.append(n)
                    for column, value in zip(columns, hit):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            arrays = [ids.take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "notice", "start", "end", "edits", "matched"])

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return spread_out(picked).mapInArrow(run, SCHEMA.format(id=kind))
