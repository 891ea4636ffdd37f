import random

import numpy as np
import pyarrow as pa
import pytest

from spanfold.llm.simhash import RADIUS, WORDS, Sorted, best_cut, by_population, components, cut, drop_near_duplicates, fingerprints, forest, meetings, near_groups, near_pairs
from tests.llm import edge


def groups_of(pairs, nodes):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def brute(prints, radius):
    n = len(prints)
    d = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :])
    near = d.sum(2, dtype=int) <= radius
    return groups_of([(i, j) for i in range(n) for j in range(i) if near[i, j]], range(n))


@pytest.mark.parametrize("radius", [0, 3, RADIUS])
def test_forest_joins_what_brute_force_joins(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, (150, WORDS), dtype=np.uint64)
    noisy = base[rng.integers(0, 150, 400)].copy()
    for _ in range(radius // 2 + 1):
        noisy[np.arange(400), rng.integers(0, WORDS, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    prints = by_population(np.unique(np.concatenate([base, noisy]), axis=0))
    want = brute(prints, radius)
    u, v = forest(prints, None, radius)
    assert groups_of(zip(u.tolist(), v.tolist()), range(len(prints))) == want
    half = len(prints) // 2
    edges = [(int(a), int(b)) for part in (prints[:half], prints[half:]) for a, b in zip(*forest(part, None, radius))]
    edges = edges[: len(forest(prints[:half], None, radius)[0])] + [(a + half, b + half) for a, b in edges[len(forest(prints[:half], None, radius)[0]) :]]
    u, v = forest(prints[:half], prints[half:], radius)
    assert groups_of(edges + list(zip(u.tolist(), v.tolist())), range(len(prints))) == want


def test_fingerprint_by_hand():
    """Bits as one text at a time gives them."""
    texts = ["a b c a b", "one", "", None, "x y", "long words " * 900, "!!", "a b c a b"]
    made, some = fingerprints(pa.array(texts))
    assert some.tolist() == [True, True, False, False, True, True, False, True]
    for i, t in enumerate(texts):
        alone, _ = fingerprints(pa.array([t], pa.string()))
        assert (made[i] == alone[0]).all()
    assert (made[0] == made[7]).all()


def corpus(seed=1, copies=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, truth = [], {}
    for g in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        for _ in range(rng.choice([1, 2, copies])):
            made = list(text)
            for _ in range(len(made) * 3 // 100 if len(rows) % 2 else 0):
                made[rng.randrange(len(made))] = rng.choice(words)
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(made), "en", "a", 0))
    return rows, truth


def test_groups_against_brute_force(spark):
    rows, truth = corpus()
    made, _ = fingerprints(pa.array([r[1] for r in rows]))
    want = brute(made.view(np.uint64).reshape(-1, WORDS), RADIUS)
    for sides in ((4096, 262_144), (16, 16)):
        got = {r.doc_id: r.group_id for r in near_groups(edge.table(spark, rows), sides=sides).collect()}
        assert got == want
    # and the groups are those of the texts
    assert len({(want[i], g) for i, g in truth.items()}) == len(set(truth.values())) == len(set(want.values()))


def test_tasks_of_many_cells(spark, monkeypatch):
    """Cells that share a task are told apart, also where they begin and end within a batch."""
    rows, _ = corpus(4)
    df = edge.table(spark, rows)
    want = sorted((r.doc_id, r.group_id) for r in near_groups(df).collect())
    monkeypatch.setattr("spanfold.llm.simhash.TASKS", 2)
    assert sorted((r.doc_id, r.group_id) for r in near_groups(df, sides=(16, 16)).collect()) == want


def test_one_of_each_group_stays(spark):
    rows, truth = corpus(2)
    kept = drop_near_duplicates(edge.table(spark, rows)).collect()
    assert sorted(truth[r.doc_id] for r in kept) == sorted(set(truth.values()))


def test_edge_rows(spark):
    df = edge.table(spark, extra=["group_id", "keep", "text_hash", "label", "k0", "k1", "k2", "row", "some", "print", "group", "first", "n", "__k0", "__keep", "__rows"])
    assert near_groups(df).columns == ["doc_id", "group_id", "group_size", "keep"]
    rows = near_groups(df).collect()
    assert len(rows) == len(edge.ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].group_id == 2 and by[2][0].keep and by[2][0].group_size == 1
    assert by[3][0].keep and by[4][0].keep and by[8][0].keep
    same = [r for r in by[6] if r.group_size == 2]
    assert len(same) == 2 and all(r.keep for r in same)
    kept = drop_near_duplicates(df).collect()
    assert len(kept) == len(edge.ROWS) - 1
    assert kept[0].asDict().keys() == df.first().asDict().keys()
    assert near_groups(edge.table(spark, [])).collect() == []
    assert drop_near_duplicates(edge.table(spark, [])).collect() == []


def test_equal_texts_without_ids(spark):
    rows = [(None, "the same long text of words", "en", "a", 1)] * 3 + [(4, "the same long text of words", "en", "a", 1), (None, "", "en", "a", 1), (None, "", "en", "a", 1)]
    kept = drop_near_duplicates(edge.table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", "the same long text of words"), ("None", ""), ("None", "")]


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in edges], "u binary, v binary")
    got = {int(r.node): int(r.label) for r in components(df).collect()}
    want = groups_of(edges, {x for e in edges for x in e})
    assert got == want


def test_pairs_are_decided_by_the_whole_distance():
    """Differences of 60 bits wherever they stand, as all in one word and as the most in each half."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (300, WORDS), dtype=np.uint64)
    others = base.copy()
    for i in range(300):
        bits = np.zeros(256, bool)
        inside = [np.arange(60), np.r_[0:30, 128:158], np.r_[64:94, 192:222], np.r_[0:40, 200:220], rng.permutation(256)[:60]][i % 5]
        bits[inside] = True
        if i % 10 > 4:
            bits[np.flatnonzero(~bits)[0]] = True  # one bit too many
        others[i] ^= np.packbits(bits).view(np.uint64)
    a, b = by_population(base), by_population(others)
    far = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=int)
    got = sorted((int(i), int(j)) for p, q in near_pairs(a, b, RADIUS) for i, j in zip(p, q))
    assert got == [(int(i), int(j)) for i, j in zip(*np.nonzero(far <= RADIUS))] and len(got) == 150


def test_equal_texts_without_a_word(spark):
    marks = [(i, "!!! ... ###", "en", "a", 11) for i in (5, 3, 9, 3, None)] + [(6, "🎂🎂", "en", "a", 2), (2, "🎂🎂", "en", "a", 2), (1, "!!! ...  ###", "en", "a", 12)]
    df = edge.table(spark, marks + [(7, "  \n", "en", "a", 3), (8, "  \n", "en", "a", 3), (8, "  \n", "en", "a", 3), (10, None, "en", "a", 0), (11, "", "en", "a", 0)])
    groups = sorted((str(r.doc_id), r.group_id, r.group_size) for r in near_groups(df).collect() if r.group_size > 1)
    assert groups == [("2", 2, 2), ("3", 3, 5), ("3", 3, 5), ("5", 3, 5), ("6", 2, 2), ("9", 3, 5), ("None", 3, 5)]
    kept = [r.doc_id for r in drop_near_duplicates(df).collect()]
    assert sorted(kept) == [1, 2, 3, 7, 8, 8, 10, 11]


def noisy(rng, count, copies, flips):
    """Distinct fingerprints, the last of them copies of the first with up to so many bits changed."""
    base = rng.integers(0, 2**64, (count, WORDS), dtype=np.uint64)
    made = base[:copies].copy()
    for _ in range(flips):
        made[np.arange(copies), rng.integers(0, WORDS, copies)] ^= np.uint64(1) << rng.integers(0, 64, copies).astype(np.uint64)
    return np.unique(np.concatenate([base, made]), axis=0)


@pytest.mark.parametrize("radius", [0, 1, 3, 20, RADIUS, 90])
def test_chunks_find_what_brute_force_finds(radius):
    """Within one table and between two, whole and in parts; also pairs that differ in exactly the radius, wherever."""
    rng = np.random.default_rng(radius)
    prints = noisy(rng, 500, 200, radius + radius // 4)
    exact = prints[:200].copy()
    for i in range(200):
        bits = np.zeros(256, bool)
        bits[(np.arange(radius + i % 2) * (1 + i % 4) + i) % 256 if i % 3 else rng.permutation(256)[: radius + i % 2]] = True
        exact[i] ^= np.packbits(bits).view(np.uint64)
    prints = np.unique(np.concatenate([prints, exact]), axis=0)
    want = brute(prints, radius)
    edges = [(int(u), int(v)) for part in range(3) for u, v in zip(*forest(prints, None, radius, part, 3, 0))]
    assert groups_of(edges, range(len(prints))) == want
    third = len(prints) // 3
    a, b = prints[:third], prints[third:]
    edges = [(int(u), int(v)) for u, v in zip(*forest(a, None, radius, least=0))] + [(int(u) + third, int(v) + third) for u, v in zip(*forest(b, None, radius, least=0))]
    edges += [(int(u), int(v)) for part in range(2) for u, v in zip(*forest(a, b, radius, part, 2, 0))]
    assert groups_of(edges, range(len(prints))) == want


def test_every_pair_within_the_radius_meets_a_chunk_and_its_bound():
    rng = np.random.default_rng(11)
    for number in (16, 17, 18, 20, 25, 32):
        for radius in (0, 7, RADIUS):
            chunks = cut(radius, number)
            assert sum(c.width for c in chunks) == 256 and sum(c.most for c in chunks) == radius - number + 1
            for i in range(300):
                gap = np.zeros(256, int)
                gap[rng.permutation(256)[:radius] if i % 2 else (rng.integers(256) + np.arange(radius) * (1 + i % 9)) % 256] = 1
                round_twice = np.concatenate([gap, gap])
                covered = [bin(c.mask).count("1") for c in chunks]
                assert any(gap[c.start : c.start + c.width].sum() <= c.most and round_twice[c.start : c.start + n].sum() <= c.bound for c, n in zip(chunks, covered))


def test_few_pairs_are_looked_at():
    """Of the pairs of a table of the size where all were compared before, less than a third meet in a chunk; of a full side less than a sixth do."""
    rng = np.random.default_rng(12)
    prints = rng.integers(0, 2**64, (235_000, WORDS), dtype=np.uint64)
    for count, share in ((235_000, 1 / 3), (786_432, 1 / 6)):
        looked = 0.0
        for chunk in best_cut(count, count, RADIUS):
            left, right = (Sorted(prints, np.arange(len(prints)), chunk) for _ in range(2))
            looked += 64 * sum((hi - lo) * len(places) for lo, hi, places in meetings(left, right, chunk, 5, 64))
        assert looked < share * len(prints) ** 2


def test_chunks_join_large_components():
    """Many fingerprints near one another, so that whole blocks are of one component."""
    rng = np.random.default_rng(13)
    centre = rng.integers(0, 2**64, (1, WORDS), dtype=np.uint64)
    crowd = np.repeat(centre, 2_000, axis=0)
    for _ in range(20):
        crowd[np.arange(2_000), rng.integers(0, WORDS, 2_000)] ^= np.uint64(1) << rng.integers(0, 64, 2_000).astype(np.uint64)
    prints = np.concatenate([crowd, noisy(rng, 2_000, 600, 40)])
    want = groups_of(zip(*(e.tolist() for e in forest(by_population(prints), None, RADIUS, least=len(prints)))), range(len(prints)))
    got = groups_of(zip(*(e.tolist() for e in forest(by_population(prints), None, RADIUS, least=0))), range(len(prints)))
    assert got == want


def test_groups_do_not_depend_on_the_sides(spark):
    """Small sides by chunks, in parts and over several cells, against all pairs."""
    rows, _ = corpus(7)
    df = edge.table(spark, rows)
    want = sorted((r.doc_id, r.group_id) for r in near_groups(df).collect())
    for sides in ((0, 786_432), (0, 40)):
        assert sorted((r.doc_id, r.group_id) for r in near_groups(df, sides=sides).collect()) == want
