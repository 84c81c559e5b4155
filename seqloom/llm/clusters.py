"""Clusters of mutually similar vectors, by bisecting k-means with an exact check of links.

A tree of two-means splits divides the vectors: the node of the largest dispersion is split first, until every leaf is
compact or has few rows. Upper trees are fitted on a bounded sample and spread all vectors over cells; the nodes of
a cell are split on by all its rows, in parallel across the cluster. Vectors near a dividing plane go to both sides,
so that clusters which a plane cuts are joined again, and TABLES upper trees with other planes each do so.

The check: in a compact leaf (all within half the limit angle of its centre) every two vectors are linked; in others
cosines are compared, in double precision where single precision could be wrong. What the planes of a cell divide is
compared again by the centres and radii of its components, so that no link within a cell is missed. Links in a cell are
joined to local components, each named by its smallest entry, and the components of all cells by alternating stars over
these names only. So no pairs are emitted: an entry has one row for each cell in which it has a neighbour.

`leaves` reports the leaves themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import small
from .components import components
from .vectors import LEAST_FIT, WIDTH, Blocks, classes, entries, grouped, matrix, pack, places, route, sample, spread, unit, unpack, usable

#: Rows of a cell and of a leaf; how near to a dividing plane a vector goes to both sides, in cells and in leaves; upper trees.
CELL_ROWS, LEAF_ROWS, REACH, LEAF_REACH, TABLES = 8_000, 1_000, 0.025, 0.04, 2
SLACK = 3e-6
#: Entries of a cluster that are described in one task; larger clusters are described from sums.
MOST_HELD = 10_000


class BisectingTree:
    """Nodes are split by two-means until they have at most `most` of the `rows` that x is a sample of, or all of x within `compact` (a cosine) of the centre."""

    def __init__(self, x: np.ndarray, most: int, seed: int, reach: float, compact: float = 2.0, rounds: int = 8, rows: int | None = None):
        self.reach = reach
        self.nodes: list[tuple | None] = [None]
        self.compact: set[int] = set()
        rng = np.random.default_rng(seed)
        whole = float(len(x) if rows is None else rows)
        queue = [(-self._dispersion(x), 0, np.arange(len(x)), whole, x.mean(0) if len(x) else np.zeros(WIDTH, np.float32), 0.0)]
        while queue:
            _, node, at, many, centre, above = heapq.heappop(queue)
            if many <= most:
                continue
            y = x[at]
            if len(y) >= 8:
                centre = y.mean(0)
            fits = len(y) >= (2 if rows is None else LEAST_FIT)
            if fits:
                if float((y @ (centre / max(float(np.linalg.norm(centre)), 1e-12))).min()) >= compact:
                    self.compact.add(node)
                    continue
                plane = self._two_means(y, rng, rounds)
            elif above > 0:  # the sample is used up: any plane through the centre
                d = rng.standard_normal(len(centre))
                d = (d / np.linalg.norm(d)).astype(np.float32)
                plane = d, float(centre @ d), above
            else:
                plane = None
            if plane is None:
                continue
            side = y @ plane[0] > plane[1]
            left, right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [None, None]
            self.nodes[node] = (*plane, left, right)
            share = float(side.mean()) if fits else 0.5
            for kid, part, weight in ((left, at[~side], 1 - share), (right, at[side], share)):
                heapq.heappush(queue, (-self._dispersion(x[part]), kid, part, many * weight, centre, plane[2]))

    @staticmethod
    def _dispersion(y: np.ndarray) -> float:
        """Sum of squared distances from the mean of unit vectors."""
        return float(len(y) * (1 - (y.mean(0) ** 2).sum())) if len(y) else 0.0

    @staticmethod
    def _two_means(y: np.ndarray, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, float, float] | None:
        """(direction of unit length, offset, distance of the centres), or None if the rows don't divide."""
        for _ in range(3):
            a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
            for _ in range(rounds):
                side = y @ (a - b) > (a @ a - b @ b) / 2
                if side.all() or not side.any():
                    break
                new = y[side].mean(0), y[~side].mean(0)
                if max(np.abs(new[0] - a).max(), np.abs(new[1] - b).max()) < 1e-4:
                    a, b = new
                    break
                a, b = new
            d = a - b
            far = float(np.linalg.norm(d))
            if far > 1e-5:
                side = y @ d > (a @ a - b @ b) / 2
                if side.any() and not side.all():
                    return (d / far).astype(np.float32), float((a @ a - b @ b) / 2 / far), far
        return None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, row) of every visit: the leaves in which, or near which, a row of x lies."""
        stack = [(0, np.arange(len(x)))]
        leaf, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            split = self.nodes[node]
            if split is None:
                leaf.append(np.full(len(at), node))
                row.append(at)
                continue
            direction, offset, far, left, right = split
            margin = x[at] @ direction - offset
            reach = min(self.reach, 0.15 * far)
            stack.append((right, at[margin > -reach]))
            stack.append((left, at[margin <= reach]))
        return np.concatenate(leaf), np.concatenate(row)


class Trees:
    """The cells of several upper trees."""

    def __init__(self, drawn: np.ndarray, rows: int, cell_rows: int, tables: int, seed: int, reach: float):
        self.trees: list[tuple[BisectingTree, int]] = []
        start = 0
        for t in range(tables):
            # Each tree has its own part of the sample, so that its planes differ.
            tree = BisectingTree(drawn[t::tables] if len(drawn) >= tables * LEAST_FIT else drawn, cell_rows, seed + t, reach, rows=rows)
            self.trees.append((tree, start))
            start += len(tree.nodes)
            if len(tree.nodes) == 1:  # one cell has all vectors
                break

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(start, tree(x)) for tree, start in self.trees]
        return np.concatenate([leaf + start for start, (leaf, _) in found]), np.concatenate([row for _, (_, row) in found])


def _linked(x: np.ndarray, exact: np.ndarray, least: float) -> np.ndarray:
    """Mask of the pairs of rows of x with a cosine that is at least `least` after rounding to 6 decimals."""
    s = x @ x.T
    np.fill_diagonal(s, -1)
    mask = s >= least + SLACK
    r, c = places((s >= least - SLACK) & ~mask)
    if len(r):
        mask[r, c] = np.round(np.einsum("ij,ij->i", exact[r], exact[c]), 6) >= least
    return mask


def _leaf_labels(x: np.ndarray, exact: np.ndarray, least: float) -> np.ndarray:
    """For each row the least row of its component, -1 for rows without link."""
    n = len(x)
    label = np.full(n, -1)
    if n <= 4 * LEAF_ROWS:
        mask = _linked(x, exact, least)
        at = np.flatnonzero(mask.any(1))
        if not len(at):
            return label
        mask = mask[np.ix_(at, at)]
        own = np.arange(len(at))
        while True:
            low = np.minimum(own, np.where(mask, own[None, :], n).min(1))
            low = low[low]
            if (low == own).all():
                break
            own = low
        label[at] = at[own]
        return label
    # A leaf that doesn't divide: from one row to its neighbours and on, each row against those not yet reached.
    todo = np.arange(n)
    while len(todo):
        start, todo = todo[0], todo[1:]
        front, group = np.array([start]), [np.array([start])]
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for i in range(0, len(front), 512):
                s = x[todo] @ x[front[i : i + 512]].T
                near |= (s >= least + SLACK).any(1)
                r, c = np.nonzero((s >= least - SLACK) & (s < least + SLACK) & ~near[:, None])
                if len(r):
                    near[r[np.round(np.einsum("ij,ij->i", exact[todo[r]], exact[front[i + c]]), 6) >= least]] = True
            front, todo = todo[near], todo[~near]
            group.append(front)
        members = np.concatenate(group)
        if len(members) > 1:
            label[members] = members.min()
    return label


def _between(x: np.ndarray, exact: np.ndarray, root: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Links (row, row) that join the components of a cell as far as any two vectors of it are linked.

    Rows that are alone are compared with each other; a larger component is compared with the rows that, by its centre
    and radius, may be within the limit angle of one of its members.
    """
    n = len(x)
    if n < 2:
        return
    size_of = np.bincount(root, minlength=n)
    alone = np.flatnonzero(size_of[root] == 1)

    def links(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """For each row of q with a link to p, one such link."""
        for k in range(0, len(q), 4096):
            t = x[q[k : k + 4096]] @ x[p].T
            top = t.argmax(1)
            best = t[np.arange(len(t)), top]
            for i in np.flatnonzero(best >= least - SLACK):
                if best[i] >= least + SLACK:
                    yield int(q[k + i]), int(p[top[i]])
                else:
                    near = np.flatnonzero(t[i] >= least - SLACK)
                    ok = near[np.round(exact[p[near]] @ exact[q[k + i]], 6) >= least]
                    if len(ok):
                        yield int(q[k + i]), int(p[ok[0]])

    y = x[alone]
    for i in range(0, len(y), 1024):
        s = y[i : i + 1024] @ y[i:].T
        r, c = places(s >= least - SLACK)
        r, c = r[c > r] + i, c[c > r] + i
        a, b = alone[r], alone[c]
        ok = (s[r - i, c - i] >= least + SLACK) | (np.round(np.einsum("ij,ij->i", exact[a], exact[b]), 6) >= least) if len(r) else r
        yield from zip(a[ok].tolist(), b[ok].tolist())

    order = np.argsort(root, kind="stable")
    first = np.flatnonzero(np.diff(root[order], prepend=-1))
    size = np.diff(np.append(first, n))
    many = np.flatnonzero(size > 1)
    if not len(many):
        return
    number = np.empty(n, np.int64)
    number[order] = np.repeat(np.arange(len(size)), size)
    centre = np.add.reduceat(x[order], first, axis=0)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    inner = np.minimum.reduceat(np.einsum("ij,ij->i", x[order], centre[number[order]]), first)
    reach = np.minimum(np.arccos(np.clip(inner, -1, 1)) + float(np.arccos(np.clip(least - 1e-6, -1, 1))) + 2e-3, np.pi)
    for i in range(0, len(many), 512):
        block = many[i : i + 512]
        s = centre[block] @ x.T
        r, c = places(s >= np.cos(reach[block]).astype(np.float32)[:, None])
        # Of two larger components, the first looks for the second.
        keep = (number[c] > block[r]) | (size[number[c]] == 1)
        r, c = r[keep], c[keep]
        starts = np.searchsorted(r, np.arange(len(block) + 1))
        for k, a in enumerate(block.tolist()):
            if starts[k] < starts[k + 1]:
                yield from links(order[first[a] : first[a] + size[a]], c[starts[k] : starts[k + 1]])


def cell_components(vectors: np.ndarray, ids: list[np.ndarray], least: float, seed: int = 2, most: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(entry, root): each entry of the cell that has a link in it, and the smallest entry of its local component."""
    exact = unit(vectors)
    x = exact.astype(np.float32)
    parent = list(range(len(x)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    compact = float(np.sqrt((1 + least) / 2)) + 1e-4
    tree = BisectingTree(x, most, seed, LEAF_REACH, compact)
    linked = np.fromiter(map(len, ids), np.int64, len(ids)) > 1
    for _, at in grouped(*tree(x)):
        if len(at) < 2:
            continue
        y = x[at]
        centre = y.mean(0)
        centre /= max(float(np.linalg.norm(centre)), 1e-12)
        label = np.zeros(len(at), np.int64) if float((y @ centre).min()) >= compact else _leaf_labels(y, exact[at], least)
        on = np.flatnonzero(label >= 0)
        linked[at[on]] = True
        for i, j in zip(at[on].tolist(), at[label[on]].tolist()):
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for i, j in _between(x, exact, np.array([top(i) for i in range(len(x))], np.int64), least):
        linked[[i, j]] = True
        a, b = top(i), top(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = np.flatnonzero(linked)
    roots = np.array([top(i) for i in rows], np.int64)
    sizes = np.array([len(ids[i]) for i in rows], np.int64)
    entry = np.concatenate([ids[i] for i in rows]) if len(rows) else np.empty(0, np.int64)
    group = np.repeat(roots, sizes)
    order = np.lexsort((entry, group))
    entry, group = entry[order], group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return entry, np.repeat(entry[first], np.diff(np.append(first, len(group))))


def clusters(df: DataFrame, least: float = 0.9, cell_rows: int = CELL_ROWS, seed: int = 1, tables: int = TABLES, exact: bool = False) -> DataFrame:
    """(entry_id, cluster_id): each entry in a cluster of two or more, and the smallest entry of the cluster.

    df: entry_id and pools. Only vectors of 64 finite numbers, not all zero, count; repeated rows of an entry are one
    entry; null ids are no entries. Two entries are linked if the cosine of their vectors, rounded to 6 decimals, is
    at least `least`; clusters are the connected components. Every link that is used is exact, and no link within a
    cell is missed. A link is missed if in each upper tree a plane divides the two vectors by more than twice the reach
    and no other entries join them (README.md has measured figures). With `exact` all pairs are compared instead, in
    blocks, at a cost that grows with the square of the rows. An empty table gives no rows.
    """
    source = entries(df)
    drawn, rows = sample(source)
    cells = Blocks(rows, cell_rows) if exact else Trees(drawn, rows, cell_rows, tables, seed, REACH)

    def cell(table: pa.Table) -> pa.Table:
        vectors, ids, follow = classes(table)
        entry, root = cell_components(vectors, ids, least) if ids else (np.empty(0, np.int64),) * 2
        after = np.concatenate([f[1:] for f in follow]) if follow else np.empty(0, np.int64)
        first = np.concatenate([np.full(len(f) - 1, f[0]) for f in follow]) if follow else np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate((entry, after))), pa.array(np.concatenate((root, first))), pa.array(np.arange(len(entry) + len(after)) >= len(entry))], ["entry", "root", "follows"])

    found = checkpoint(spread(route(source, cells, 2)).groupBy("cell").applyInArrow(cell, "entry bigint, root bigint, follows boolean").distinct())
    least_root = found.filter("not follows").groupBy("entry").agg(F.min("root").alias("root"), F.max("root").alias("most"), F.collect_set("root").alias("roots"))
    least_root = checkpoint(least_root)
    edges = least_root.filter("root <> most").select(F.col("root").alias("v"), F.explode("roots").alias("u"))
    joined = components(edges).withColumnsRenamed({"node": "r", "root": "cluster"})
    named = least_root.join(joined, F.col("root") == F.col("r"), "left").select(F.col("entry").alias("entry_id"), F.coalesce("cluster", "root").alias("cluster_id"))
    # Copies beyond those that were compared belong where the first of their group does.
    after = found.filter("follows").select(F.col("entry").alias("copy"), "root").join(named.withColumnRenamed("entry_id", "root"), "root")
    return named.unionByName(after.select(F.col("copy").alias("entry_id"), "cluster_id")).groupBy("entry_id").agg(F.min("cluster_id").alias("cluster_id"))


def leaves(df: DataFrame, compact: float = 0.9, most: int = LEAF_ROWS, cell_rows: int = CELL_ROWS, seed: int = 1) -> DataFrame:
    """(entry_id, cluster_id): the leaf of the bisecting tree that each usable entry lies in, named by the leaf's smallest entry.

    As `clusters`, but without the check of links: a leaf is split until all its entries are within `compact` (a cosine)
    of its centre, or it has one distinct vector. Each entry lies in one leaf; of an entry with several different
    vectors the least counts. `describe` gives sizes and centre-nearest members.
    """
    drawn, rows = sample(entries(df))
    tree = BisectingTree(drawn, cell_rows, seed, 0.0, rows=rows)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, row = tree(unit(unpack(batch.column("vec").to_pylist())).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(cell[np.argsort(row)].astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    def divide(table: pa.Table) -> pa.Table:
        entry, packed = table.column("entry_id").to_numpy(), table.column("vec").to_pylist()
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(p, len(index)) for p in packed])
        x = unit(unpack(list(index))).astype(np.float32)
        leaf, row = BisectingTree(x, 1, seed, 0.0, compact)(x)
        label = np.empty(len(x), np.int64)
        label[row] = leaf
        label = label[of]
        order = np.lexsort((entry, label))
        entry, label = entry[order], label[order]
        first = np.flatnonzero(np.diff(label, prepend=-1))
        return pa.table([pa.array(entry), pa.array(np.repeat(entry[first], np.diff(np.append(first, len(label)))))], ["entry_id", "cluster_id"])

    return _vectors(df).mapInArrow(homes, "cell int, entry_id bigint, vec binary").groupBy("cell").applyInArrow(divide, "entry_id bigint, cluster_id bigint")


def _vectors(df: DataFrame) -> DataFrame:
    """(entry_id, vec): one packed vector for each entry with a usable one; of several different ones the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            ok = usable(v)
            yield pa.RecordBatch.from_arrays([batch.column("entry_id").filter(pa.array(ok)), pa.array(pack(v[ok]), pa.binary())], ["entry_id", "vec"])

    return entries(df).mapInArrow(run, "entry_id bigint, vec binary").groupBy("entry_id").agg(F.min("vec").alias("vec"))


def _portray(cluster: np.ndarray, entry: np.ndarray, vec: list[bytes], typical: int) -> pa.RecordBatch:
    """A row for each cluster, whose rows follow each other: its size, mean cosine with the centre and the nearest entries."""
    x = unit(unpack(vec))
    first = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1))
    size = np.diff(np.append(first, len(cluster)))
    centre = np.add.reduceat(x, first, axis=0)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    of = np.repeat(np.arange(len(first)), size)
    cosine = np.round(np.einsum("ij,ij->i", x, centre[of]), 9)
    order = np.lexsort((entry, -cosine, of))
    nth = np.arange(len(order)) - np.repeat(first, size)
    top = order[nth < typical]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.minimum(size, typical)))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(cluster[first]), pa.array(size.astype(np.int64)), pa.array(np.round(np.add.reduceat(cosine, first) / size, 9)), pa.ListArray.from_arrays(offsets, pa.array(entry[top]))], ["cluster_id", "size", "compactness", "typical"])


def describe(df: DataFrame, found: DataFrame, typical: int = 3, most: int = MOST_HELD) -> DataFrame:
    """(cluster_id, size, compactness, typical): of each cluster its size, its mean cosine with the centre, and the entries nearest to it.

    df: entry_id and pools; found: entry_id, cluster_id, unique entries. The centre is the mean of the unit vectors;
    cosines are rounded to 9 decimals, of equal ones the smaller entry comes first. An entry with several different
    vectors counts with the least of them. The table is read once, and vectors are shuffled twice: to their clusters'
    names and to their clusters. Clusters of up to `most` entries lie in one task each; of larger ones only sums of
    batches travel, and the centres are joined back. Without clusters there are no rows.
    """
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("size"))
    named = found.select("entry_id", "cluster_id").join(sizes.hint("shuffle_hash"), "cluster_id")
    # Merge joins: the estimate for a column of bytes takes all vectors for a table that can be broadcast.
    members = _vectors(df).hint("merge").join(named, "entry_id").select("cluster_id", "entry_id", "vec", "size")
    salt = F.when(F.col("size") > most, F.pmod(F.xxhash64("entry_id"), F.ceil(F.col("size") / most))).otherwise(0)
    members = checkpoint(members.withColumn("salt", salt).repartition("cluster_id", "salt").sortWithinPartitions("cluster_id", "entry_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, entry, vec = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            cluster = np.concatenate((cluster, batch.column("cluster_id").to_numpy()))
            entry = np.concatenate((entry, batch.column("entry_id").to_numpy()))
            vec += batch.column("vec").to_pylist()
            done = int(np.searchsorted(cluster, cluster[-1])) if len(cluster) else 0  # the last one may go on
            if done:
                yield _portray(cluster[:done], entry[:done], vec[:done], typical)
                cluster, entry, vec = cluster[done:], entry[done:], vec[done:]
        if len(cluster):
            yield _portray(cluster, entry, vec, typical)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, x = batch.column("cluster_id").to_numpy(), unit(unpack(batch.column("vec").to_pylist()))
            first = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1))
            yield pa.RecordBatch.from_arrays([pa.array(cluster[first]), pa.array(np.add.reduceat(x, first, axis=0).tolist())], ["cluster_id", "s"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, entry, x = batch.column("cluster_id").to_numpy(), batch.column("entry_id").to_numpy(), unit(unpack(batch.column("vec").to_pylist()))
            cosine = np.round(np.einsum("ij,ij->i", x, matrix(batch.column("centre"), np.float64)), 9)
            order = np.lexsort((entry, -cosine, cluster))
            cluster, entry, cosine = cluster[order], entry[order], cosine[order]
            first = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1))
            top = [list(zip((-cosine[a : min(b, a + typical)]).tolist(), entry[a : min(b, a + typical)].tolist())) for a, b in zip(first, [*first[1:], len(cluster)])]
            each = pa.array([[{"loss": c, "entry": e} for c, e in t] for t in top], pa.list_(pa.struct([("loss", pa.float64()), ("entry", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(cluster[first]), pa.array(np.diff(np.append(first, len(cluster)))), pa.array(np.add.reduceat(cosine, first)), each], ["cluster_id", "n", "cosine", "top"])

    few = members.filter(F.col("size") <= most).select("cluster_id", "entry_id", "vec").mapInArrow(whole, "cluster_id bigint, size bigint, compactness double, typical array<bigint>")
    many = members.filter(F.col("size") > most).select("cluster_id", "entry_id", "vec")
    each = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(WIDTH)]
    centres = many.select("cluster_id", "vec").mapInArrow(sums, "cluster_id bigint, s array<double>").groupBy("cluster_id").agg(*each)
    length = F.greatest(F.sqrt(sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(WIDTH)), F.lit(0.0))), F.lit(1e-12))
    # At most one row for each `most` entries, and broadcast only if counted.
    centres = small(centres.select("cluster_id", F.array(*(F.col(f"s{i}") / length for i in range(WIDTH))).alias("centre")))
    near = many.join(centres, "cluster_id").select("cluster_id", "entry_id", "vec", "centre")
    near = near.mapInArrow(nearest, "cluster_id bigint, n bigint, cosine double, top array<struct<loss: double, entry: bigint>>")
    top = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, typical)
    large = near.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.round(F.sum("cosine") / F.sum("n"), 9).alias("compactness"), F.transform(top, lambda t: t["entry"]).alias("typical"))
    return few.unionByName(large)
