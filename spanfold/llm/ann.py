"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import written

NEIGHBOURS = 10
#: Dimensions of the projection; even, as the closed form of the chi-square distribution used here asks.
DIMENSIONS = 8
#: Chance, at least, that a true neighbour lies within the projected distance at which a search stops.
CONFIDENCE = 0.98
#: Rows of a cell of the outer tree, of a leaf of the inner one, and of a batch of queries.
CELL, LEAF, QUERIES = 8_192, 256, 1_024
#: Rows from which the outer tree's planes are chosen; they bear on the work of a search, not on its result.
PLANE_ROWS = 20_000
#: Numbers from this size on are taken for errors, as their squares can't be added up.
LARGEST = 1e150
#: Cells of the outer tree, whose boxes the driver holds; beyond, cells are cut into blocks.
MOST_CELLS = 1 << 17


def chi_square(x: float, m: int) -> float:
    """P(chi-square with m degrees of freedom <= x), m even."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


def plane(dims: int, m: int, seed: int) -> np.ndarray:
    """dims x m independent standard normal numbers (2-stable)."""
    return np.random.default_rng(seed).standard_normal((dims, m))


class Tree:
    """kd-tree over points: rows in leaf order and the box of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        cuts = [(0, len(points))]
        bounds: list[tuple[int, int]] = []
        while cuts:
            a, b = cuts.pop()
            if b - a <= leaf:
                if b > a:
                    bounds.append((a, b))
                continue
            part = points[order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            cuts += [(a, a + middle), (a + middle, b)]
        bounds.sort()
        self.order, self.bounds = order, bounds
        self.low = np.array([points[order[a:b]].min(0) for a, b in bounds])
        self.high = np.array([points[order[a:b]].max(0) for a, b in bounds])

    def gaps(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.bounds)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            out += np.maximum(0, np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d])) ** 2
        return out


class Cell:
    """The points of a cell and the search among them."""

    def __init__(self, uids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.tree = Tree(vectors @ matrix)
        self.uids, self.vectors = uids[self.tree.order], vectors[self.tree.order]
        self.sorted = np.argsort(self.uids)
        # single precision screens, double precision decides; numbers too large for that are screened in double
        kind = np.float32 if np.abs(vectors).max() < 1e12 else np.float64
        plain = self.vectors.astype(kind)
        self.norms = (plain**2).sum(1)
        # one product of these with (-2 query, 1, its norm) gives the squared distances
        self.screen = np.concatenate([plain, self.norms[:, None], np.ones((len(plain), 1), kind)], 1)
        self.slack = 64 * float(np.finfo(kind).eps)

    def own_places(self, uids: np.ndarray) -> np.ndarray:
        """Where each query itself stands among the points, -1 where it doesn't."""
        at = self.sorted[np.minimum(np.searchsorted(self.uids, uids, sorter=self.sorted), len(self.uids) - 1)]
        return np.where(self.uids[at] == uids, at, -1)

    def search(self, uids: np.ndarray, queries: np.ndarray, k: int, stop: float, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and places of the k nearest that each query finds here, none farther than `best` (inf and -1 where there are fewer).

        Leaves are taken by projected distance, in growing portions; a query ends when the next one's exceeds
        stop times the squared distance of its k-th neighbour so far (`best` is what it has from elsewhere).
        """
        n = len(queries)
        gaps = self.tree.gaps(queries @ self.matrix)
        nearest = np.argsort(gaps, axis=1, kind="stable")
        gaps = np.take_along_axis(gaps, nearest, 1)
        distances, found = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        plain = queries.astype(self.screen.dtype)
        q_norms = (plain**2).sum(1)
        screened = np.concatenate([-2 * plain, np.ones((n, 1), plain.dtype), q_norms[:, None]], 1)
        own = self.own_places(uids)
        at, step, live = 0, 8 if np.isfinite(best).all() else 4, np.arange(n)
        while len(live) and at < gaps.shape[1]:
            end = min(at + step, gaps.shape[1])
            limit = np.minimum(distances[live, k - 1], best[live])
            row, leaf = live.repeat(end - at), nearest[live, at:end].ravel()
            wanted = gaps[live, at:end].ravel() <= stop * limit.repeat(end - at)
            row, leaf = row[wanted], leaf[wanted]
            order = np.argsort(leaf, kind="stable")
            row, leaf = row[order], leaf[order]
            for x in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                if len(x):
                    self._verify(leaf[x[0]], row[x], queries, screened, q_norms, own, k, best, distances, found)
            at, step = end, step * 2
            if at < gaps.shape[1]:
                live = live[gaps[live, at] <= stop * np.minimum(distances[live, k - 1], best[live])]
        return distances, found

    def _verify(self, leaf: int, r: np.ndarray, queries: np.ndarray, screened: np.ndarray, q_norms: np.ndarray, own: np.ndarray, k: int, best: np.ndarray, distances: np.ndarray, found: np.ndarray) -> None:
        """Put the rows of a leaf that are nearer than what queries r have in their place, in distances and found."""
        a, b = self.tree.bounds[leaf]
        d = screened[r] @ self.screen[a:b].T
        here = np.flatnonzero((own[r] >= a) & (own[r] < b))
        d[here, own[r[here]] - a] = np.inf
        slack = self.slack * (q_norms[r] + self.norms[a:b].max())
        limit = np.minimum(distances[r, k - 1], best[r])
        fresh = np.flatnonzero(np.isinf(limit))
        if len(fresh) and b - a > k:
            limit[fresh] = np.partition(d[fresh], k - 1, axis=1)[:, k - 1] + slack[fresh]
        hit = np.flatnonzero(d <= (limit + slack).astype(d.dtype)[:, None])
        if not len(hit):
            return
        i, j = hit // (b - a), hit % (b - a) + a
        exact = ((queries[r[i]] - self.vectors[j]) ** 2).sum(1)
        good = np.isfinite(d.ravel()[hit]) & (exact <= best[r[i]])
        i, j, exact = i[good], j[good], exact[good]
        if not len(i):
            return
        changed = np.unique(i)
        rows = r[changed]
        # what these queries had and what is new, in order of distance; the first k of each stay
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), np.searchsorted(changed, i)])
        both, names = np.concatenate([distances[rows].ravel(), exact]), np.concatenate([found[rows].ravel(), j])
        order = np.lexsort((both, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], np.arange(len(rows)))[owner[order]]
        order = order[nth < k]
        distances[rows], found[rows] = both[order].reshape(-1, k), names[order].reshape(-1, k)


def outer_planes(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and value of each inner node of a complete tree of that depth, in heap order."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            axis = int(np.argmax(part.std(0))) if len(part) > 1 else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            nodes.append((axis, value))
            side = part[:, axis] > value
            below += [part[~side], part[side]]
        level = below
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for _ in range(depth):
        axes = np.array([a for a, _ in nodes])[at]
        values = np.array([v for _, v in nodes])[at]
        at = 2 * at + 1 + (points[np.arange(len(points)), axes] > values)
    return at - ((1 << depth) - 1)


def reached(points: np.ndarray, limits: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, cell) whose squared distance is within the point's limit, by descent from the root of the outer tree."""
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(depth):
        row, node = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2])
        q = points[row]
        gap = (np.maximum(0, np.maximum(low[node] - q, q - high[node])) ** 2).sum(1)
        near = (gap <= limits[row]) & np.isfinite(gap)
        row, node = row[near], node[near]
    return row, node - ((1 << depth) - 1)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def neighbours(table: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", m: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = 11, cell_rows: int = CELL, asked: Column | str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """For every row that is asked for (a condition on the table; all rows by default) its k nearest other rows of the whole
    table: vec_id, rank (from 1), neighbour_id, distance (Euclidean).

    Vectors are projected on m normal directions: a pair at distance d has a projected squared distance of d^2
    times a chi-square variable with m degrees of freedom. An outer tree, whose planes come from a bounded sample, cuts
    the projected space into cells of about cell_rows rows. Each query first searches its own cell, then each other
    cell that the stopping test leaves, given the k-th distance that it has by then; within a cell a kd-tree gives leaves by
    projected distance, whose rows are verified in full dimension until the test holds: the next projected distance
    exceeds the chi-square quantile times the k-th distance. A true neighbour is missed with a chance of at most 1 - confidence.

    Cells that hold far more rows than others (a third of all vectors may be copies of one) are cut into blocks by hash, and a
    query of the cell goes to each of its blocks, so no task holds more than some cell_rows rows.

    Vectors that are null, of another length than most (the commonest one, the longer of ties), or that hold a null, NaN or a number of LARGEST or more are
    neither queries nor neighbours. Null ids and repeated ids or rows are rows like others: equal vectors are
    neighbours at distance 0. A table of n rows gives min(k, n - 1) neighbours each; none for one row or none. Ties in distance rank by id
    (null first) among those found. Other columns are not read but by the condition.
    """
    if m % 2 or m < 2:
        raise ValueError("m must be even")
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = table.sparkSession
    kind = table.schema[id_col].dataType.simpleString()
    # float vectors are sent as they are; what decides is computed in double
    numbers = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col(f"`{vector_col}`").cast(numbers)
    wanted = F.lit(True) if asked is None else F.coalesce(F.expr(asked) if isinstance(asked, str) else asked, F.lit(False))
    rows = table.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"), wanted.alias("asked")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST))) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = f"vec_id {kind}, rank int, neighbour_id {kind}, distance double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, total = lengths
    rows = rows.where(F.size("v") == dims)
    matrix = plane(dims, m, seed)
    stop = quantile(confidence, m)
    depth = min(max(0, math.ceil(math.log2(max(1, total / cell_rows)))), int(math.log2(most_cells)))
    cells = 1 << depth

    # a bounded number of rows, whatever the table's size, to choose planes from
    sampled = rows.select("v").sample(fraction=min(1.0, PLANE_ROWS / total), seed=seed).toPandas() if depth else None
    nodes = outer_planes(np.array(sampled["v"].tolist()).reshape(-1, dims) @ matrix, depth) if depth else []
    names = [f"p{d}" for d in range(m)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"), dims) @ matrix
            cell = cell_of(points, nodes, depth) if depth else np.zeros(len(points), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "id", "v", "asked")), pa.array(cell.astype(np.int32)), *(pa.array(points[:, d]) for d in range(m))], names=["uid", "id", "v", "asked", "cell", *names])

    numbered = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "v", "asked")
    # written, so that a row keeps its uid whatever is run again
    stored = written(numbered.mapInArrow(assign, f"uid long, id {kind}, v {numbers}, asked boolean, cell int, " + ", ".join(f"{n} double" for n in names)), "vectors")
    bounds = [f(n).alias(f"{b}_{n}") for n in names for b, f in (("lo", F.min), ("hi", F.max))]
    boxes = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *bounds).toLocalIterator()}  # one row a cell
    low, high = np.full((2 * cells - 1, m), np.inf), np.full((2 * cells - 1, m), -np.inf)  # of the tree's nodes, in heap order
    for c, r in boxes.items():
        low[cells - 1 + c], high[cells - 1 + c] = [r[f"lo_{n}"] for n in names], [r[f"hi_{n}"] for n in names]
    for node in range(cells - 2, -1, -1):
        low[node], high[node] = np.minimum(low[2 * node + 1], low[2 * node + 2]), np.maximum(high[2 * node + 1], high[2 * node + 2])
    crowded = {c: -(-r["rows"] // cell_rows) for c, r in boxes.items() if r["rows"] > 4 * cell_rows}
    units, cut = cells, []
    for c, n in crowded.items():
        cut.append((c, n, units))  # its block 0 has the cell's number, the others follow all cells
        units += n - 1
    # at most as many rows as cells
    blocks = F.broadcast(spark.createDataFrame(cut, "cell int, blocks int, further int")) if cut else None

    def unit(block: str) -> Column:
        return F.expr(f"if({block} = 0, cell, further + {block} - 1)").cast("int").alias("unit")

    found_schema = f"uid long, id {kind}, other long, neighbour_id {kind}, d2 double"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a unit come before the queries sent to it: points are held, queries stream by."""
        held: list[tuple] = []
        number, now, point_ids = None, None, None
        for batch in batches:
            c, query = batch.column("unit").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(c) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(c)]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                uid, v, best = part.column("uid").to_numpy(), _matrix(part.column("v"), dims), part.column("best").to_numpy(zero_copy_only=False)
                if number != c[a]:
                    number, held, now = c[a], [], None
                if not query[a]:
                    held.append((uid, v, part.column("id")))
                    continue
                if now is None:
                    if not held:
                        continue
                    now = Cell(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), matrix)
                    point_ids = pa.concat_arrays([h[2] for h in held]).take(pa.array(now.tree.order))
                for at in range(0, len(uid), QUERIES):
                    u = uid[at : at + QUERIES]
                    d, places = now.search(u, v[at : at + QUERIES], k, stop, best[at : at + QUERIES])
                    some = places >= 0
                    asker, place = pa.array(at + np.repeat(np.arange(len(u)), some.sum(1))), places[some]
                    yield pa.RecordBatch.from_arrays([part.column("uid").take(asker), part.column("id").take(asker), pa.array(now.uids[place]), point_ids.take(pa.array(place)), pa.array(d[some])], names=["uid", "id", "other", "neighbour_id", "d2"])

    def searched(queries: DataFrame) -> DataFrame:
        points = stored.select("cell", F.lit(False).alias("query"), "uid", "id", "v", F.lit(float("inf")).alias("best"))
        queries = queries.select("cell", F.lit(True).alias("query"), "uid", "id", "v", "best")
        columns = ["query", "uid", "id", "v", "best"]
        if blocks is None:
            sent = points.unionAll(queries).withColumnRenamed("cell", "unit")
        else:
            points = points.join(blocks, "cell", "left").withColumn("block", F.coalesce(F.expr("cast(pmod(xxhash64(uid), blocks) AS int)"), F.lit(0)))
            queries = queries.join(blocks, "cell", "left").withColumn("block", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
            sent = points.select(unit("block"), *columns).unionAll(queries.select(unit("block"), *columns))
        parts = min(units, 20_000)
        return sent.repartitionById(parts, F.col("unit") % parts).sortWithinPartitions("unit", "query").mapInArrow(look, found_schema)

    own = written(searched(stored.where("asked").withColumn("best", F.lit(float("inf")))), "near")
    hits = own
    if cells > 1:
        limits = own.groupBy("uid").agg(F.sort_array(F.collect_list("d2")).alias("all")).select("uid", F.expr(f"if(size(all) >= {k}, all[{k - 1}], double('inf'))").alias("best"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(at, QUERIES)
                    points = np.stack([part.column(n).to_numpy() for n in names], 1)
                    row, cell = reached(points, stop * part.column("best").to_numpy(zero_copy_only=False), low, high, depth)
                    other = cell != part.column("cell").to_numpy()[row]
                    row, cell = row[other], cell[other]
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(part.column(c).take(taken) for c in ("uid", "id", "v", "best"))], names=["cell", "uid", "id", "v", "best"])

        routed = stored.where("asked").join(limits, "uid", "left").withColumn("best", F.coalesce("best", F.lit(float("inf"))))
        hits = own.unionAll(searched(routed.mapInArrow(route, f"cell int, uid long, id {kind}, v {numbers}, best double")))
    # the k least of a query, of at most k from each unit it visited
    best = hits.groupBy("uid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "neighbour_id", "other", "id"))), 1, k).alias("top"))
    ranked = best.select(F.posexplode("top").alias("at", "hit"))
    return ranked.select(F.col("hit.id").alias("vec_id"), (F.col("at") + 1).alias("rank"), F.col("hit.neighbour_id").alias("neighbour_id"), F.sqrt("hit.d2").alias("distance"))
