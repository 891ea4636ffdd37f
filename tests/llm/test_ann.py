import math

import numpy as np
import pytest

from spanfold.llm.ann import Tree, chi_square, neighbours, plane, quantile

SCHEMA = "vec_id long, embedding array<float>, rank string, uid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def recall(rows, x, ids, k):
    at = {v: i for i, v in enumerate(ids)}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, 1)[:, k - 1]
    return sum(d[at[r.vec_id], at[r.neighbour_id]] <= kth[at[r.vec_id]] + 1e-9 for r in rows) / (len(ids) * k)


def test_chi_square():
    assert chi_square(15.507, 8) == pytest.approx(0.95, abs=1e-4)
    assert chi_square(quantile(0.98, 8), 8) == pytest.approx(0.98)
    assert quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    x = np.random.default_rng(0).standard_normal((2000, 64))
    ratio = ((x @ plane(64, 8, 1)) ** 2).sum(1) / (x**2).sum(1)
    assert (ratio <= quantile(0.95, 8)).mean() == pytest.approx(0.95, abs=0.05)


def test_tree_boxes_hold_their_points():
    points = np.random.default_rng(1).standard_normal((1000, 4))
    tree = Tree(points, 10)
    assert sorted(tree.order.tolist()) == list(range(1000))
    q = np.random.default_rng(2).standard_normal((5, 4))
    gaps = tree.gaps(q)
    for leaf, (a, b) in enumerate(tree.bounds):
        assert b - a <= 10
        inside = ((q[:, None] - points[tree.order[a:b]][None]) ** 2).sum(-1).min(1)
        assert (gaps[:, leaf] <= inside + 1e-9).all()


@pytest.mark.parametrize("cell_rows", [8192, 100])
def test_recall_of_all_rows(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32)) * 3
    x = (centres[rng.integers(0, 12, 700)] + rng.standard_normal((700, 32))).astype(np.float32).astype(float)
    rows = neighbours(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), 10, cell_rows=cell_rows).collect()
    assert len(rows) == 7000
    assert recall(rows, x, list(range(700)), 10) >= 0.9
    for r in rows:
        assert r.distance == pytest.approx(np.linalg.norm(x[r.vec_id] - x[r.neighbour_id]), abs=1e-5)
    for i in (0, 350):
        own = sorted((r for r in rows if r.vec_id == i), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [r.distance for r in own] == sorted(r.distance for r in own)
        assert i not in [r.neighbour_id for r in own]


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = df.toPandas()
    rows = neighbours(df, cell_rows=60).collect()
    assert recall(rows, np.array(pdf.embedding.tolist(), float), pdf.vec_id.tolist(), 10) >= 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [None, 1.0]), (9, [5.0, 5.0])]
    got = neighbours(table(spark, rows), 3).collect()
    assert len(got) == 5 * 3
    assert {r.vec_id for r in got} == {1, 2, None, 9}
    assert sorted(r.distance for r in got if r.vec_id == 1) == [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]
    assert len(neighbours(table(spark, rows[:3]), 10).collect()) == 3 * 2
    assert neighbours(table(spark, rows[:1])).collect() == []
    assert neighbours(table(spark, [])).collect() == []


def test_stated_queries_against_all_rows_and_a_crowded_cell(spark):
    """A third of all vectors are copies of one, so that their cell is cut into blocks; a fifth of the rows are queries."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16)).astype(np.float32).astype(float)
    x[rng.permutation(900)[:300]] = x[0]
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    rows = neighbours(df, 5, cell_rows=20, most_cells=8, asked="vec_id % 5 = 0").collect()
    assert {r.vec_id for r in rows} == set(range(0, 900, 5)) and len(rows) == 180 * 5
    d = ((x[::5, None] - x[None]) ** 2).sum(-1)
    d[np.arange(180), np.arange(0, 900, 5)] = np.inf
    kth = np.sort(d, 1)[:, 4]
    assert sum(d[r.vec_id // 5, r.neighbour_id] <= kth[r.vec_id // 5] + 1e-9 for r in rows) / len(rows) >= 0.9
    assert neighbours(df, 5, asked="vec_id < 0").collect() == []


def test_large_and_small_numbers(spark):
    """Single precision only screens: what it can't tell apart or hold is decided in double."""
    rows = [(i, [1e100 * i, 1e100]) for i in range(4)]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    assert {(r.vec_id, r.neighbour_id) for r in got} <= {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)} and len(got) == 4
    near = [(i, [1000.0 + i * 1e-6, 1.0]) for i in range(6)]
    got = neighbours(spark.createDataFrame(near, "vec_id long, embedding array<double>"), 2).collect()
    assert all(abs(r.vec_id - r.neighbour_id) <= 2 for r in got) and len(got) == 12
