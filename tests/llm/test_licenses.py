import random

import pytest

from spanfold.llm.licenses import NOTICES, Scanner, apart, pieces, scan_licenses
from tests.llm import edge


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ends(notice, text, k):
    """Where some substring within k edits of the notice ends (Sellers)."""
    row = list(range(len(notice) + 1))
    out = []
    for j, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        for i, x in enumerate(notice, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        if row[-1] <= k:
            out.append(j)
    return out


def mutated(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        what = rng.randrange(3)
        if what == 0:
            chars[at] = rng.choice("abcxyz ")
        elif what == 1:
            chars.insert(at, rng.choice("abcxyz "))
        else:
            del chars[at]
    return "".join(chars)


def test_pieces_cover_the_notice():
    for k in range(6):
        assert "".join(p for _, p in pieces("released under", k)) == "released under"


def test_against_brute_force():
    rng = random.Random(5)
    notices = {"one": "Released under the MIT License", "two": "All rights reserved"}
    scanner = Scanner(notices, 0.1)
    for _ in range(60):
        text = " ".join(rng.choice([mutated(rng, rng.choice(list(notices.values())), rng.randrange(5)), "lorem ipsum under the", "x" * rng.randrange(9), "rights reserve"]) for _ in range(6))
        found = scanner.scan(text)
        for name, start, end, edits, matched in found:
            assert matched == text[start:end]
            assert edits == distance(notices[name].lower(), matched.lower())
            assert edits <= int(len(notices[name]) * 0.1)
        for name, notice in notices.items():
            for e in ends(notice.lower(), text.lower(), int(len(notice) * 0.1)):
                assert any(s < e + 4 and f > e - len(notice) for _, s, f, _, _ in found), (text, name, e, found)


def test_the_better_of_two_that_overlap_stands():
    assert apart([(1, 0, -10, 0), (0, 0, -10, 1), (2, 20, -30, 0)], 10) == [(0, 10, 1, 0), (20, 30, 0, 2)]


def test_edge_rows(spark):
    df = edge.table(spark, extra=["notice", "start", "end", "matched"])
    assert [(r.doc_id, r.notice, r.matched) for r in scan_licenses(df).collect()] == [(1, "MIT", "Licensed under the MIT License")]
    again = [(9, None, None, None, None), (None, "released UNDER the MIT Licence", "en", "a", 1), (9, "İ" * 3 + " All rights reserved.", "en", "a", 1)]
    rows = sorted((str(r.doc_id), r.notice, r.start, r.end, r.edits) for r in scan_licenses(edge.table(spark, again * 2)).collect())
    assert rows == [("9", "All-rights", 4, 23, 0)] * 2 + [("None", "MIT", 0, 30, 1)] * 2
    assert scan_licenses(edge.table(spark, [])).collect() == []


def test_an_empty_notice_raises():
    with pytest.raises(ValueError):
        Scanner({"x": ""}, 0.1)


def test_every_notice_is_found_exactly():
    scanner = Scanner(NOTICES, 0.1)
    for name, notice in [(name, w) for name, ws in NOTICES.items() for w in ([ws] if isinstance(ws, str) else ws)]:
        assert (name, 3, 3 + len(notice), 0) in [x[:4] for x in scanner.scan("ab " + notice.upper() + ".")]


def test_many_repeats_take_time_in_proportion():
    """A megabyte of inexact repeats without a gap, each of them found."""
    import time

    scanner = Scanner(NOTICES, 0.1)
    began = time.process_time()
    found = scanner.scan("All rights reservd. " * 50_000)
    assert time.process_time() - began < 20
    assert len(found) == 50_000 and {x[3] for x in found} == {1}
    assert [x[1] for x in found] == list(range(0, 1_000_000, 20))


def test_what_is_left_beside_a_better_match_is_searched_again():
    """Greedy choice among all matches, listed by brute force."""
    rng = random.Random(8)
    notice, k = "all rights reserved", 3
    scanner = Scanner({"n": notice}, 0.17)
    for _ in range(40):
        text = "".join(rng.choice([notice, notice[4:], notice[:-3], mutated(rng, notice, 2), mutated(rng, notice, 4), " "]) for _ in range(5))
        matches = sorted((distance(notice, text[a:b]), a, -b) for a in range(len(text)) for b in range(a + len(notice) - k, min(len(text), a + len(notice) + k) + 1) if distance(notice, text[a:b]) <= k)
        want = []
        for e, a, b in matches:
            if all(-b <= s or a >= f for _, s, f in want):
                want.append((e, a, -b))
        got = [(e, a, b) for _, a, b, e, _ in scanner.scan(text)]
        assert [x[0] for x in sorted(got)] == [x[0] for x in sorted(want)], text
