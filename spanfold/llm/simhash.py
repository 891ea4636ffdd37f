"""SimHash near-duplicate groups: every pair of fingerprints within the radius is found, through the chunks in which it must be close."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import remove, spread, spread_out, tokenize, written

BITS = 256
WORDS = BITS // 64
#: Bits in which near duplicates may differ. Unrelated texts differ in 128 on average, with a deviation of 8.
RADIUS = 60
#: Texts whose words are in memory at once.
SLICE = 2_048
#: Fingerprints of a tile in cache, and rows compared with it at once.
TILE, ROWS = 4_096, 16
#: Fingerprints of a cell's side: up to the first number all pairs of a cell are looked at, beyond it those that meet in a chunk; no side is larger than the second.
SIDES = (16_384, 786_432)
#: Tasks among which cells are divided, at most, and parts of a cell, at most.
TASKS, PARTS = 20_000, 24
#: Pairs that are held before they are compared in full.
HELD = 262_144

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STEPS = np.arange(WORDS, dtype=np.uint64) * _A
#: Each bit of a byte in a byte of its own, so that up to 255 of these add up without carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_bits(features: np.ndarray) -> np.ndarray:
    """(features, 32) bytes, independent for each feature."""
    return np.stack([mix(features + k) for k in _STEPS], 1).view(np.uint8)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 32) bytes of the texts' fingerprints, and whether a row has one (it has at least a word)."""
    codes, vocabulary, offsets = tokenize(texts)
    rows = len(texts)
    out = np.zeros((rows, BITS // 8), np.uint8)
    counts = np.diff(offsets)
    if not len(codes):
        return out, counts > 0
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))[codes]
    # the word pairs of a text; its only word where it has but one
    pairs = mix(words[:-1] * _A + words[1:] * _B)
    firsts = np.maximum(counts - 1, 0)
    features = np.where(counts == 1, 1, firsts)
    starts = np.cumsum(features) - features
    hashed = np.empty(int(features.sum()), np.uint64)
    inner = np.ones(len(codes), bool)
    inner[offsets[1:][counts > 0] - 1] = False
    is_pair = np.repeat(counts > 1, features)
    hashed[is_pair] = pairs[inner[:-1]] if len(pairs) else pairs
    hashed[~is_pair] = mix(words[offsets[:-1][counts == 1]] * _A)
    some = np.flatnonzero(features)
    # blocks of at most 255 features, none over two texts
    blocks = -(-features[some] // 255)
    block_text = np.repeat(np.arange(len(some)), blocks)
    nth = np.arange(len(block_text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_start = starts[some][block_text] + 255 * nth
    ones = np.zeros((len(some), BITS), np.int64)
    step = 256
    for a in range(0, len(block_start), step):
        lo, hi = block_start[a], block_start[a + step] if a + step < len(block_start) else len(hashed)
        h = hashed[lo:hi]
        raw = hashed_bits(h)
        sums = np.add.reduceat(_SPREAD[raw], block_start[a : a + step] - lo, axis=0)
        np.add.at(ones, block_text[a : a + step], sums.view(np.uint8).reshape(len(sums), BITS))
    least = np.minimum.reduceat(hashed, starts[some])
    tied = np.unpackbits(hashed_bits(least), axis=1)
    total = features[some][:, None]
    bits = np.where(2 * ones == total, tied, 2 * ones > total)
    out[some] = np.packbits(bits.astype(np.uint8), axis=1)
    return out, counts > 0


def not_blank(text_col: str) -> Column:
    """Whether a text has more than white space; true or false, for null too."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"(?U)\S"), F.lit(False))


def with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the 32 bytes of each text's fingerprint, null where the text has no word."""

    @F.arrow_udf("binary")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [fingerprints(texts.slice(at, SLICE)) for at in range(0, len(texts), SLICE)]
            yield pa.array([r.tobytes() if s else None for made, some in parts for r, s in zip(made, some)], pa.binary())

    return docs.withColumn(name, fingerprint(F.col(f"`{text_col}`").cast("string")))


def fold_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the pairs, in place; a label is the least member's number."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b, (n, WORDS) numbers in order of population count, that differ in at most radius bits.

    Tiles whose population counts exclude that (of the whole, or of words) are skipped. In the others each pair is looked at:
    one within the radius differs in at most half of it in one half of the fingerprint, and there the differing bits of
    both words laid over one another are no more than that. Pairs of which that holds are compared in full.
    """
    tiles = []
    for side in (a, b):
        ones = np.bitwise_count(side).astype(np.int64)
        tiles.append([(c, ones[c : c + TILE].min(0), ones[c : c + TILE].max(0), ones[c : c + TILE].sum(1)) for c in range(0, len(side), TILE)])
    x, y = (np.empty((ROWS, TILE), np.uint64) for _ in range(2))
    c, d = (np.empty((ROWS, TILE), np.uint8) for _ in range(2))
    for p, low, high, sums in tiles[0]:
        for q, low_b, high_b, sums_b in tiles[1]:
            gaps = np.maximum(0, np.maximum(low - high_b, low_b - high))
            whole = max(sums.min() - sums_b.max(), sums_b.min() - sums.max())
            if max(gaps.sum(), whole) > radius:
                continue
            right = b[q : q + TILE]
            columns = np.ascontiguousarray(right.T)
            m = len(right)
            for r in range(p, min(p + TILE, len(a)), ROWS):
                left = a[r : min(r + ROWS, p + TILE)]
                n = len(left)
                for k, out in ((0, c), (2, d)):
                    np.bitwise_xor(left[:, k : k + 1], columns[k], out=x[:n, :m])
                    np.bitwise_xor(left[:, k + 1 : k + 2], columns[k + 1], out=y[:n, :m])
                    np.bitwise_or(x[:n, :m], y[:n, :m], out=x[:n, :m])
                    np.bitwise_count(x[:n, :m], out=out[:n, :m])
                hit = np.flatnonzero(np.minimum(c[:n, :m], d[:n, :m]) <= radius // 2)
                if not len(hit):
                    continue
                i, j = hit // m, hit % m
                apart = np.bitwise_count(left[i] ^ right[j])
                near = apart.sum(1, dtype=np.int64) <= radius
                if near.any():
                    yield r + i[near], q + j[near]


class Chunk(NamedTuple):
    """Some successive bits of a fingerprint, and how much two near ones may differ there."""

    start: int
    width: int
    most: int  # bits that may differ in the chunk; none begins here if it is negative
    mask: int  # of the 64 bits from start on, those of whole chunks
    bound: int  # bits that may differ in these


def cut(radius: int, number: int) -> list[Chunk]:
    """The fingerprint in so many chunks, of which each pair within the radius meets the limits of at least one.

    Chunk i may differ in T[i] bits, and these add up to radius - number + 1. The differences less T[i] + 1 then add up to less than 0, so that going round
    from behind the last place where their running sum is greatest, every running sum is less than 0: the first l chunks from there differ
    in at most the sum of their T, and l - 1 more. A chunk with its successors that fit into 64 bits is held against that.
    """
    starts = [k * BITS // number for k in range(2 * number + 1)]  # once round and on
    each, more = divmod(radius - number + 1, number)
    most = [each + (k < more) for k in range(number)]
    chunks = []
    for k in range(number):
        run = 1
        while run < number and starts[k + run + 1] - starts[k] <= 64:
            run += 1
        bits = starts[k + run] - starts[k]
        chunks.append(Chunk(starts[k], starts[k + 1] - starts[k], most[k], (1 << 64) - (1 << (64 - bits)), sum(most[i % number] for i in range(k, k + run)) + run - 1))
    return chunks


def best_cut(left: int, right: int, radius: int) -> list[Chunk]:
    """Chunks, of 16 bits at most, by which so many fingerprints on either side meet in the least time, as estimated for evenly spread ones."""

    def seconds(chunks: list[Chunk]) -> float:
        total = 0.0
        for c in chunks:
            near = sum(comb(c.width, d) for d in range(min(c.most, c.width) + 1))
            values = min(left, 1 << c.width)
            total += (near > 0) * values * (5e-5 + 3e-8 * near + near * right / (1 << c.width) * (1e-8 + 2e-9 * left / values))
        return total

    return min((cut(radius, number) for number in range(BITS // 16, BITS // 8 + 1)), key=seconds)


class Sorted:
    """Fingerprints in order of a chunk's value, and by label where it is equal."""

    def __init__(self, prints: np.ndarray, label: np.ndarray, chunk: Chunk) -> None:
        word, shift = divmod(chunk.start, 64)
        bits = prints[:, word]
        if shift:  # behind the last bit the first follows
            bits = (bits << np.uint64(shift)) | (prints[:, (word + 1) % WORDS] >> np.uint64(64 - shift))
        keys = (bits >> np.uint64(64 - chunk.width)).astype(np.uint16)
        order = np.argsort(label, kind="stable")
        self.rows = order[np.argsort(keys[order], kind="stable")]
        self.bits = bits[self.rows] & np.uint64(chunk.mask)
        self.sizes = np.bincount(keys, minlength=1 << chunk.width)
        self.starts = np.cumsum(self.sizes) - self.sizes


def meetings(left: Sorted, right: Sorted, chunk: Chunk, part: int = 0, parts: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """Places lo to hi on the left that agree in the chunk, and those on the right that differ there in few enough bits.

    Where both are the same, each two values meet once. Of several parts, each has its own values on the left.
    """
    flips = np.flatnonzero(np.bitwise_count(np.arange(1 << chunk.width)) <= chunk.most)
    for key in np.flatnonzero(left.sizes).tolist():
        if key % parts != part:
            continue
        others = key ^ flips
        if left is right:
            others = others[others >= key]
        places = spread(right.starts[others], right.sizes[others])
        if len(places):
            yield left.starts[key], left.starts[key] + left.sizes[key], places


def close(ours: np.ndarray, theirs: np.ndarray, bound: int, room: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of numbers that differ in at most bound bits. There are few, so they are looked for in columns that have some, eight together."""
    x, c, h = room
    for r in range(0, len(ours), 2 * ROWS):
        left = ours[r : r + 2 * ROWS, None]
        n = len(left)
        wide = ROWS * TILE // n // 8 * 8
        for q in range(0, len(theirs), wide):
            right = theirs[q : q + wide]
            m = len(right)
            eights = -(-m // 8)
            apart = np.bitwise_xor(left, right, out=x[: n * m].reshape(n, m))
            counts = np.bitwise_count(apart, out=c[: n * m].reshape(n, m))
            met = h[: n * eights].reshape(n, eights)
            met[:, -1] = 0
            np.less_equal(counts, bound, out=met.view(bool)[:, :m])
            some = np.flatnonzero(np.bitwise_or.reduce(met, axis=0))
            if len(some):
                hit = np.flatnonzero(met.take(some, axis=1).view(bool))
                i, j = np.divmod(hit, 8 * len(some))
                yield r + i, q + 8 * some[j // 8] + j % 8


def join_met(a: np.ndarray, b: np.ndarray | None, radius: int, label: np.ndarray, part: int, parts: int) -> None:
    """Join, in label, what the pairs within the radius join that meet in the given part of some chunk's values; over all parts none is left out.

    Fingerprints of a component aren't looked at again where they meet a block that is of that one altogether.
    """
    other, shift = (a, 0) if b is None else (b, len(a))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, large = 0, False
    room = [np.empty(ROWS * TILE, kind) for kind in (np.uint64, np.uint8, np.uint64)]

    def join() -> None:
        """Compare the pairs held in full and join those within the radius."""
        nonlocal size, large
        if held:
            i, j = (np.concatenate(ends) for ends in zip(*held))
            new = label[i] != label[j + shift]
            i, j = i[new], j[new]
            near = np.bitwise_count(a[i] ^ other[j]).sum(1, dtype=np.int64) <= radius
            if near.any():
                fold_labels(label, i[near], j[near] + shift)
                large = bool(np.bincount(label).max() > ROWS)
        held.clear()
        size = 0

    for chunk in best_cut(len(a), len(other), radius):
        if chunk.most < 0:
            continue
        left = Sorted(a, label[: len(a)], chunk)
        right = left if b is None else Sorted(other, label[shift:], chunk)
        for lo, hi, places in meetings(left, right, chunk, part, parts):
            step = ROWS if large else hi - lo
            for r in range(lo, hi, step):
                rows, at = left.rows[r : min(r + step, hi)], places
                of = label[rows]
                if large and len(of) > 1 and (of == of[0]).all():
                    at = places[label[right.rows[places] + shift] != of[0]]
                for i, j in close(left.bits[r : r + len(rows)], right.bits[at], chunk.bound, room):
                    held.append((rows[i], right.rows[at[j]]))
                    size += len(i)
                    if size >= HELD:
                        join()
        join()


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, part: int = 0, parts: int = 1, least: int = SIDES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as row numbers of a followed by b, that join what the near pairs of a cell join, or over all parts of it together."""
    size = len(a) + (0 if b is None else len(b))
    label = np.arange(size)
    if max(len(a), size - len(a)) > least:
        join_met(a, b, radius, label, part, parts)
    elif not part:
        for i, j in near_pairs(a, a if b is None else b, radius):
            fold_labels(label, i, j + (0 if b is None else len(a)))
    member = np.flatnonzero(label != np.arange(size))
    return member, label[member]


def by_population(numbers: np.ndarray) -> np.ndarray:
    return numbers[np.argsort(np.bitwise_count(numbers).sum(1, dtype=np.int64), kind="stable")]


def near_edges(prints: DataFrame, name: str, radius: int, sides: tuple[int, int] = SIDES) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, enough to join all within the radius of each other.

    Fingerprints are put in order of population count by arithmetic on the counts of their 257 values and cut
    into G sides. The sides whose population counts allow a pair with one of side g are a range, and each fingerprint goes to
    the cells (g, h) of its side and that range; the driver holds three numbers a side. Few large cells are worked on in parts, each with all
    fingerprints of its cell.
    """
    ones = sum(F.bit_count(F.conv(F.hex(F.substring(name, 8 * k + 1, 8)), 16, -10).cast("long")) for k in range(WORDS)).cast("int")
    distinct = prints.select(F.col(name), ones.alias("ones"))
    counted = {r["ones"]: r["count"] for r in distinct.groupBy("ones").count().collect()}  # 257 values at most
    total = sum(counted.values())
    n = max(1, -(-total // sides[1]))
    start, low, high = {}, [BITS] * n, [0] * n
    seen = 0
    for p in sorted(counted):
        start[p] = seen
        for g in range(min(n - 1, seen * n // max(total, 1)), min(n - 1, (seen + counted[p] - 1) * n // max(total, 1)) + 1):
            low[g], high[g] = min(low[g], p), max(high[g], p)
        seen += counted[p]
    least = [bisect_left(high, low[g] - radius) for g in range(n)]
    most = [bisect_right(low, high[g] + radius) - 1 for g in range(n)]
    ranges = prints.sparkSession.createDataFrame([(g, min(g, least[g]), max(g, most[g])) for g in range(n)], "side int, least int, most int")

    within = F.pmod(F.xxhash64(name), F.lit(1 << 20))
    starts = F.array(*(F.lit(start.get(p, 0)).cast("long") for p in range(BITS + 1)))
    sizes = F.array(*(F.lit(counted.get(p, 0)).cast("long") for p in range(BITS + 1)))
    place = starts[F.col("ones")] + F.shiftright(sizes[F.col("ones")] * within, 20)
    sided = distinct.select(F.col(name).alias("print"), F.least(F.lit(n - 1), F.floor(place * n / max(total, 1))).cast("int").alias("side"))
    met = sided.join(ranges, "side").select("print", "side", F.explode(F.sequence("least", "most")).alias("other"))
    g, h = F.least("side", "other").cast("long"), F.greatest("side", "other").cast("long")
    cell = g * n - F.expr("least(side, other) * (cast(least(side, other) AS long) - 1) div 2") + h - g  # places in the upper triangle, row by row
    cells = n * (n + 1) // 2
    parts = 1 if total <= n * sides[0] else max(1, min(PARTS, -(-4 * prints.sparkSession.sparkContext.defaultParallelism // cells)))
    tasks = max(1, min(cells * parts, TASKS))
    sent = met.select((cell * parts).alias("cell"), (F.col("side") <= F.col("other")).alias("first"), (F.col("side") == F.col("other")).alias("alone"), "print")
    if parts > 1:
        sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select((F.col("cell") + F.col("part")).alias("cell"), "first", "alone", "print")
    # by part of a cell, so that a task of several holds one at a time
    sent = sent.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell")

    def joined(held: list[tuple[np.ndarray, np.ndarray]], alone: bool, part: int) -> Iterator[pa.RecordBatch]:
        """Edges of a part of a cell, whose fingerprints are these, with whether they are of the first side; the list is emptied."""
        a, b = (np.concatenate([numbers[first == ours] for first, numbers in held]) for ours in (True, False))
        held.clear()
        if max(len(a), len(b)) <= sides[0]:
            a, b = by_population(a), by_population(b)
        b = None if alone else b
        u, v = forest(a, b, radius, part, parts, sides[0])
        both = a if b is None else np.concatenate([a, b])
        for lo in range(0, len(u), 50_000):
            ends = [pa.array([x.tobytes() for x in both[e[lo : lo + 50_000]]], pa.binary()) for e in (u, v)]
            yield pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, alone = None, False
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cells)]):
                if hi == lo:
                    continue
                if held and cells[lo] != now:
                    yield from joined(held, alone, now % parts)
                now, alone = cells[lo], batch.column("alone")[lo].as_py()
                raw = b"".join(batch.column("print").slice(lo, hi - lo).to_pylist())
                held.append((batch.column("first").to_numpy(zero_copy_only=False)[lo:hi], np.frombuffer(raw, np.uint64).reshape(-1, WORDS)))
        if held:
            yield from joined(held, alone, now % parts)

    return sent.mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges and the least node of its component.

    Large-star and small-star steps in turn until nothing changes: a number of rounds that grows with the
    logarithm of the longest chain. Every round is written to the shared folder, so a lost executor costs one step.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (state := mark(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        done, now = now, written(small.where("u != v").distinct(), "edges")
        remove(done)
    return now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _groups(docs: DataFrame, id_col: str, text_col: str, radius: int, sides: tuple[int, int]) -> DataFrame:
    """near_groups() with text_hash, a hash of the text that tells rows of one id apart."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bare = F.when(F.col("print").isNull() & not_blank("text"), F.col("text"))
    hashed = with_fingerprint(spread_out(picked), "text", "print").select("doc_id", F.xxhash64("text").alias("text_hash"), "print", bare.alias("bare"))
    rows = written(hashed, "prints")
    prints = written(rows.where("print is not null").select("print").distinct(), "distinct")
    labels = components(near_edges(prints, "print", radius, sides))
    remove(prints)
    some = rows.where("print is not null").join(labels.withColumnRenamed("node", "print"), "print", "left")
    some = some.select("doc_id", "text_hash", F.coalesce("label", "print").alias("group"))
    wordless = rows.where("bare is not null").select("doc_id", "text_hash", F.col("bare").cast("binary").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    first = F.col("first")

    def grouped(members: DataFrame) -> DataFrame:
        groups = members.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        joined = members.join(groups, "group")
        return joined.select("doc_id", "text_hash", first["d"].alias("group_id"), "group_size", (F.col("doc_id").eqNullSafe(first["d"]) & (F.col("text_hash") == first["h"])).alias("keep"))

    blank = rows.where("print is null and bare is null").select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return grouped(some).unionAll(grouped(wordless)).unionAll(blank)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, sides: tuple[int, int] = SIDES) -> DataFrame:
    """One row for each document: doc_id, group_id (least id of its group), group_size and keep.

    A text's fingerprint has 256 bits: the signs of the sums of hashed word pairs. Texts are near duplicates
    if their fingerprints differ in at most `radius` bits, and groups are the components of that relation.
    Equal fingerprints are merged before anything is compared. Then those that differ in few bits of a chunk are looked at, for
    limits that every pair within the radius meets in some chunk (see cut()), and are compared exactly with numpy exclusive-or and bit
    counts; up to sides[0] fingerprints all pairs are. No partner or candidate is dropped.

    keep is true for one row of each group: the least id, null ids last, and among rows of that id the least hash of the text; for rows that
    agree in both it is true for all of them, and drop_near_duplicates leaves one. Texts without a word have no
    fingerprint: those that are equal (punctuation, symbols) are a group; null and blank ones are each a group of its own,
    group_id its own id. Texts of any length are read whole. Other columns are not read, whatever their names. No rows give no rows.
    """
    return _groups(docs, id_col, text_col, radius, sides).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, sides: tuple[int, int] = SIDES) -> DataFrame:
    """docs with one document of each group of near_groups; of equal rows one stays.

    Null and blank rows all stay. Columns may have any names and pass through.
    """

    def keys(doc_id: Column, text_hash: Column) -> dict[str, Column]:
        return {"k0": F.coalesce(doc_id.cast("string"), F.lit("")), "k1": doc_id.isNull(), "k2": F.coalesce(text_hash, F.lit(0))}

    groups = written(_groups(docs, id_col, text_col, radius, sides), "groups")
    marked = groups.withColumns(keys(F.col("doc_id"), F.col("text_hash"))).groupBy("k0", "k1", "k2").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    gone = marked.where("not keep or n > 1").select("k0", "k1", "k2", "keep")
    text = F.col(f"`{text_col}`").cast("string")
    # the columns of docs stay in one struct, so that no name of theirs can meet one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), not_blank(text_col).alias("some"), *(v.alias(n) for n, v in keys(F.col(f"`{id_col}`"), F.xxhash64(text)).items()))
    joined = rows.join(gone, ["k0", "k1", "k2"], "left")
    again = joined.where("keep")
    repeated = again.where("some").dropDuplicates(["k0", "k1", "k2"]).unionAll(again.where("not some"))
    return joined.where("keep is null").unionAll(repeated).select("row.*")
