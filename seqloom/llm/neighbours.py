"""The most similar vectors of every vector, by multiprobe p-stable hashing.

A compound p-stable hash: each level projects a vector on a random direction of normal numbers (2-stable, so that
distances of projections follow Euclidean distances) and cuts the line into buckets of a width taken from the spread
of the node. A vector visits its own bucket and perturbed ones, in the order of their estimated success: the squared
distances to the boundaries that are crossed add up along the levels, and the bucket sequences with the least sums are
visited, up to a limit and at most PROBES of them. Both the stored vectors and the queries do so, which doubles the
margin.

Several coarse tables spread the vectors over cells; within a cell, a finer table gives candidates. The candidates of
all tables are merged and ranked by exact cosines in double precision. Rows with very many others within the limit are
compared with their whole cell, and large dense groups in cells of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import LEAST_FIT, WIDTH, Blocks, classes, entries, grouped, places, route, sample, spread, unit

#: Rows of a cell and of a leaf, width of a bucket in standard deviations, coarse tables.
CELL_ROWS, LEAF_ROWS, BUCKET, TABLES = 8_000, 1_200, 2.25, 2
#: Rows of a cell up to which all its pairs are compared, as a table costs as much.
FEW_ROWS = 4_096
#: Reach of probes at unit distance, of coarse tables and within cells, and most buckets that a vector visits.
REACH, LEAF_REACH, PROBES = 0.12, 0.25, 24
#: Bounds the error of single-precision products of unit vectors.
SLACK = 3e-6
#: Dense groups: least cosine of crowding, of members to the centre (the limit angle), of all that may be near members (twice that angle); the share of the sample and how many of it are counted.
CROWD, INNER, OUTER, SHARE, COUNTED = 0.85, 0.9, 0.62, 1 / 128, 4096
SCALE = 1_000_000


class StableTree:
    """Buckets of a compound p-stable hash, refined until each has at most `most` of the `rows` that x is a sample of."""

    def __init__(self, x: np.ndarray, most: int, seed: int, reach: float, rows: int | None = None, probes: int = PROBES):
        self.reach2, self.probes, self.leaves, self.most = reach * reach, probes, 0, most
        mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
        self.root = self._grow(x, np.arange(len(x)), float(len(x) if rows is None else rows), mean, 0.0, np.random.default_rng(seed), 0)

    def _grow(self, x: np.ndarray, at: np.ndarray, rows: float, mean: np.ndarray, above: float, rng: np.random.Generator, depth: int):
        """rows: the estimated number; mean, above: centre and spread of the node above, where the sample is used up."""
        wide, a = 0.0, None
        fits = len(at) >= LEAST_FIT
        if rows > self.most and depth < 60:
            a = rng.standard_normal(len(mean)).astype(np.float32)
            p = x[at] @ a
            wide = float(p.std()) if fits else above
        if wide < 1e-6:
            self.leaves += 1
            return self.leaves - 1
        if len(at) >= 8:
            mean = x[at].mean(0)
        middle, width = float(mean @ a), BUCKET * wide
        offset = middle - width * rng.random()
        bucket = np.clip(np.floor((p - offset) / width), -3, 3).astype(np.int64)
        if fits:
            low, high = int(bucket.min()), int(bucket.max())
            part = [float((bucket == k).mean()) for k in range(low, high + 1)]
        else:  # the buckets of a normal distribution
            edges = [_normal((offset + width * k - middle) / wide) for k in range(-2, 4)]
            part = np.diff([0.0, *edges, 1.0])
            some = np.flatnonzero(part > 0.01)
            low, high = int(some[0]) - 3, int(some[-1]) - 3
            part = part[some[0] : some[-1] + 1] / part[some[0] : some[-1] + 1].sum()
            bucket = np.clip(bucket, low, high)
        if low == high:  # one more projection with another offset
            return self._grow(x, at, rows, mean, wide, rng, depth + 1)
        kids = [self._grow(x, at[bucket == k], rows * share, mean, wide, rng, depth + 1) for k, share in zip(range(low, high + 1), part)]
        return (a, offset, width, low, kids)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, row) of every visit: of each row of x the leaves in the order of their estimated success, none twice."""
        stack = [(self.root, np.arange(len(x)), np.zeros(len(x), np.float32))]
        leaf, row, score = [], [], []
        while stack:
            node, at, far = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                leaf.append(np.full(len(at), node))
                row.append(at)
                score.append(far)
                continue
            a, offset, width, low, kids = node
            p = (x[at] @ a - offset) / width
            last = low + len(kids) - 1
            for k, kid in enumerate(kids, low):
                # how far beyond the bucket the vector lies; the outer buckets have no outer boundary
                beyond = np.maximum(0 if k == low else k - p, 0 if k == last else p - (k + 1))
                beyond = np.maximum(beyond, 0)
                near = beyond * min(width, 2.0 * BUCKET)
                total = far + near * near
                # no farther than an eighth of a bucket in narrow nodes, which would else visit everything
                visit = (beyond == 0) | ((total <= self.reach2) & (beyond <= 0.125))
                stack.append((kid, at[visit], total[visit]))
        if not leaf:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        leaf, row, score = np.concatenate(leaf), np.concatenate(row), np.concatenate(score)
        order = np.lexsort((score, row))
        leaf, row = leaf[order], row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        return leaf[nth < self.probes], row[nth < self.probes]


def _normal(z: float) -> float:
    return 0.5 * (1 + erf(z / sqrt(2)))


class Tables:
    """The cells of several tables, and for each dense group of the sample further cells in which all its pairs meet.

    Planes can't tell the nearest in a group of different vectors that all lie near each other. So the vectors
    within the limit angle of a group's centre, and all that may be near those, are dealt into blocks, and each two
    blocks are a cell that is compared exactly. Its cost grows with the square of the group.
    """

    def __init__(self, drawn: np.ndarray, rows: int, cell_rows: int, tables: int, seed: int, reach: float, probes: int):
        self.trees: list[tuple[StableTree, int]] = []
        start = 0
        for t in range(tables):
            tree = StableTree(drawn, cell_rows, seed + t, reach, rows, probes)
            self.trees.append((tree, start))
            start += tree.leaves
            if tree.leaves == 1:  # one cell has all vectors
                break
        self.first = start
        self.groups: list[tuple[np.ndarray, Blocks]] = []
        for c in dense_centres(drawn) if len(self.trees) > 1 else ():
            many = float((drawn @ c >= OUTER).mean()) * rows
            self.groups.append((c, Blocks(int(many), cell_rows, start)))
            start = self.groups[-1][1].end

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, row = [], []
        for tree, start in self.trees:
            leaf, at = tree(x)
            cell.append(leaf + start)
            row.append(at)
        for c, blocks in self.groups:
            near = np.flatnonzero(x @ c >= OUTER)
            leaf, at = blocks(x[near])
            cell.append(leaf)
            row.append(near[at])
        return np.concatenate(cell), np.concatenate(row)


def dense_centres(drawn: np.ndarray) -> list[np.ndarray]:
    """Centres of groups that hold at least SHARE of the sample, in the order of their density."""
    y = drawn[:: max(1, len(drawn) // COUNTED)]
    near = np.concatenate([y[i : i + 512] @ y.T >= CROWD for i in range(0, len(y), 512)]) if len(y) else np.empty((0, 0), bool)
    count = near.sum(1)
    left = count >= max(8, SHARE * len(y))
    centres = []
    while left.any():
        top = int(np.where(left, count, -1).argmax())
        c = y[near[top]].mean(0)
        c /= np.sqrt((c * c).sum())
        centres.append(c.astype(np.float32))
        left &= y @ c < INNER
        left[top] = False
    return centres


def _compare(x: np.ndarray, rows: np.ndarray, others: np.ndarray, own: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other) that may be among the k best of others; own is where a row stands in others."""
    y = x[others]
    step = max(64, min(2048, 16_000_000 // max(1, len(others))))  # bounds the memory of large leaves
    for i in range(0, len(rows), step):
        s = x[rows[i : i + step]] @ y.T
        s[np.arange(len(s)), own[i : i + step]] = -1
        mask = s >= least - SLACK
        many = np.flatnonzero(mask.sum(1) > 3 * k)
        if len(many):
            best = s[many]
            cut = np.partition(best, best.shape[1] - k, axis=1)[:, -k]
            mask[many] &= best >= cut[:, None] - SLACK
        r, o = places(mask)
        yield rows[r + i], others[o]


def _crowded(x: np.ndarray, least: float) -> np.ndarray:
    """Rows that, by a sample, have so many within the limit that leaves would part them from their nearest."""
    y = x[:: max(1, len(x) // 1024)]
    most = LEAF_ROWS / 2 * len(y) / len(x)
    return np.flatnonzero(np.concatenate([(x[i : i + 4096] @ y.T >= least).sum(1) >= most for i in range(0, len(x), 4096)]))


def _candidates(x: np.ndarray, k: int, least: float, seed: int, exact: bool, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, other) of distinct pairs that may be among a row's k best; all that tie with the last are in it."""
    n = len(x)
    every = np.arange(n)
    found = []
    if n <= FEW_ROWS or exact:
        found += _compare(x, every, every, every, k, least)
    else:
        for t in range(tables):
            for _, at in grouped(*StableTree(x, LEAF_ROWS, seed + t, LEAF_REACH)(x)):
                found += _compare(x, at, at, np.arange(len(at)), k, least)
        crowded = _crowded(x, least)
        found += _compare(x, crowded, every, crowded, k, least)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.unique(np.concatenate([r for r, _ in found]).astype(np.int64) * n + np.concatenate([o for _, o in found]))
    return key // n, key % n


def _expand(groups: list[np.ndarray], sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every index in at, its group's members: (position in at, member)."""
    each = sizes[at]
    pos = np.repeat(np.arange(len(at)), each)
    return pos, flat[np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]


def best_of_cell(vectors: np.ndarray, ids: list[np.ndarray], k: int, least: float, seed: int = 3, exact: bool = False, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, loss, b): of each entry a of the cell its k best b, loss = 1,000,000 * (1 - cosine rounded to 6 decimals)."""
    x = unit(vectors)
    row, other = _candidates(x.astype(np.float32), k, least, seed, exact, tables)
    cosine = np.empty(len(row))
    for i in range(0, len(row), 100_000):
        cosine[i : i + 100_000] = np.einsum("ij,ij->i", x[row[i : i + 100_000]], x[other[i : i + 100_000]])
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    own = np.flatnonzero(sizes > 1)
    row, other = np.concatenate((row, own)), np.concatenate((other, own))
    loss = SCALE - np.rint(np.concatenate((cosine, np.ones(len(own)))) * SCALE).astype(np.int64)
    ok = loss <= round(SCALE * (1 - least))
    row, other, loss = row[ok], other[ok], loss[ok]
    flat, starts = (np.concatenate(ids) if ids else np.empty(0, np.int64)), np.cumsum(sizes) - sizes
    pos, a = _expand(ids, sizes, starts, flat, row)
    row, other, loss = row[pos], other[pos], loss[pos]
    pos, b = _expand(ids, np.minimum(sizes, k + 1), starts, flat, other)
    a, loss = a[pos], loss[pos]
    ok = a != b
    a, loss, b = a[ok], loss[ok], b[ok]
    order = np.lexsort((b, loss, a))
    a, loss, b = a[order], loss[order], b[order]
    start = np.flatnonzero(np.diff(a, prepend=a[0] - 1)) if len(a) else np.empty(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[nth < k], loss[nth < k], b[nth < k]


def most_similar(df: DataFrame, k: int = 5, least: float = 0.9, cell_rows: int = CELL_ROWS, reach: float = REACH, seed: int = 1, tables: int = TABLES, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(entry_id, best ARRAY<STRUCT<loss INT, b BIGINT>>, followers ARRAY<BIGINT>): the k most similar entries of each.

    df: entry_id and pools. Only vectors of 64 finite numbers, not all zero, count; repeated rows of an entry are one
    entry; null ids are no entries. Similarity is the cosine rounded to 6 decimals (loss = 1,000,000 * (1 - it)),
    at least `least`; of equal ones the smaller id comes first. Entries without any have no row. followers are
    entries with the very same vector as entry_id, in large groups of copies; their best are those of entry_id and
    entry_id itself, see `pairs`. The search may miss a few neighbours (README.md gives measured shares); what is
    found is exact. Dense groups of at least SHARE of the rows are compared exactly (for limits of INNER and more). The
    trees are fitted on a sample of SAMPLE vectors; every vector is stored and searched. With `exact` all pairs of
    vectors are compared instead, in blocks, at a cost that grows with the square of the rows.
    """
    source = entries(df)
    drawn, rows = sample(source)
    cells = Blocks(rows, cell_rows) if exact else Tables(drawn, rows, cell_rows, tables, seed, reach, probes)
    first_exact, inner = (0, 1) if exact else (cells.first, 1 if len(cells.trees) > 1 else TABLES)

    def cell(table: pa.Table) -> pa.Table:
        vectors, ids, follow = classes(table)
        number = table.column("cell")[0].as_py()
        a, loss, b = best_of_cell(vectors, ids, k, least, abs(number), number >= first_exact, inner) if len(ids) else (np.empty(0, np.int64),) * 3
        who, begin = np.unique(a, return_index=True)
        offsets = pa.array(np.append(begin, len(a)).astype(np.int32))
        best = [pa.ListArray.from_arrays(offsets, pa.array(loss.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(b))]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["a", "losses", "bs", "followers"]
        first = pa.table([pa.array(who), *best, pa.array([[]] * len(who), kinds[3])], names)
        second = pa.table([pa.array([int(f[0]) for f in follow], kinds[0]), pa.array([[]] * len(follow), kinds[1]), pa.array([[]] * len(follow), kinds[2]), pa.array([f[1:].tolist() for f in follow], kinds[3])], names)
        return pa.concat_tables([first, second.cast(first.schema)])

    found = spread(route(source, cells, k + 1)).groupBy("cell").applyInArrow(cell, "a bigint, losses array<int>, bs array<bigint>, followers array<bigint>")
    # A row for each cell that an entry visits, so the lists of a group are few and short.
    merged = found.groupBy("a").agg(F.collect_list(F.arrays_zip("losses", "bs")).alias("lists"), F.flatten(F.collect_list("followers")).alias("followers"))
    best = F.slice(F.array_sort(F.array_distinct(F.flatten("lists"))), 1, k)
    return merged.select(F.col("a").alias("entry_id"), F.transform(best, lambda s: F.struct(s["losses"].alias("loss"), s["bs"].alias("b"))).alias("best"), "followers")


def pairs(found: DataFrame, k: int = 5) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: the pairs of which at least one has the other among its k best."""
    first = F.array(F.struct(F.lit(0).alias("loss"), F.col("entry_id").alias("b")))
    whole = F.array_sort(F.concat("best", first))
    pair = lambda a, b: F.struct(F.least(a, b).alias("entry_a"), F.greatest(a, b).alias("entry_b"))
    theirs = lambda m: F.transform(F.slice(F.filter(whole, lambda s: s["b"] != m), 1, k), lambda s: pair(m, s["b"]))
    own = F.transform("best", lambda s: pair(F.col("entry_id"), s["b"]))
    # In one pass over found, which is not computed twice.
    rows = found.select(F.explode(F.concat(own, F.flatten(F.transform("followers", theirs)))).alias("p"))
    return rows.select("p.entry_a", "p.entry_b").filter("entry_a < entry_b").distinct()
