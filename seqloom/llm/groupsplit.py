"""Train, validation and test splits that keep related records together.

Rows are linked by protein and by isolate; each connected component lies in one split. The assignment is a
component swap search: every chain starts from a hashed assignment, and every partition anneals its own
components at the same time, moving or exchanging whole ones to reduce the deviation of sizes and of label
counts. What a partition can't even out (as it holds a very large component) is passed to the others as a changed
target in the next round, which goes on from the assignment of the last. Chains differ by seed, and the best one of
all rounds is kept. Only totals (3 splits x 5 numbers a partition and chain) travel to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import trimmed
from .components import components

SPLITS = ("train", "validation", "test")
LABELS = 3
#: Numbers that are balanced of each component: rows, rows of each label, rows without label.
WIDTH = LABELS + 2
#: Components that a task anneals, and steps of the first round for each of them (a quarter in the others) and at least.
COMPONENTS, STEPS_EACH, LEAST_STEPS = 10_000, 2, 3_000
#: Rows, and part of all rows, by which a split may be off its target in each of its numbers without another round.
NEAR_ROWS, NEAR_PART = 1.5, 0.0001


def groups(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_id, label, group_id): each row of the label table with the smallest row_id of its group.

    The protein of a row is the non-null orig_id (the least, should there be several) of a manifest row whose
    chunk_id equals the trimmed ids; without one, the trimmed ids before the first `|chunk_` or `_chunk_`, or
    all of it. Rows with one protein, or one isolate (neither null nor empty), share a group, also by way of
    other rows. A row with null ids has no protein and is linked by its isolate only; it may be a group of its
    own. Repeated row_ids are one row. Empty tables give no rows.
    """
    rows = labels.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        trimmed(F.col("ids")).alias("ids"),
        F.when(F.length("isolate") > 0, F.col("isolate")).alias("isolate"),
        F.col("labels").cast("int").alias("label"),
    ).filter("row_id is not null")
    known = manifest.filter("chunk_id is not null and orig_id is not null").groupBy(F.col("chunk_id").alias("ids")).agg(F.min("orig_id").alias("orig"))
    prefix = F.regexp_extract("ids", r"(?s)^(.*?)(?:\|chunk_|_chunk_)", 1)
    has = F.col("ids").contains("|chunk_") | F.col("ids").contains("_chunk_")
    rows = rows.join(known, "ids", "left").select("row_id", "isolate", "label", F.coalesce("orig", F.when(has, prefix).otherwise(F.col("ids"))).alias("protein"))
    # A protein is known by its least row_id from here on.
    firsts = rows.filter("protein is not null").groupBy("protein").agg(F.min("row_id").alias("node"))
    nodes = checkpoint(rows.join(firsts, "protein", "left").select("row_id", "isolate", "label", F.coalesce("node", "row_id").alias("node")))
    pairs = nodes.filter("isolate is not null").select("isolate", "node").distinct()
    least = pairs.groupBy("isolate").agg(F.min("node").alias("least"))
    roots = components(pairs.join(least, "isolate").select(F.col("node").alias("u"), F.col("least").alias("v")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The least node of a component is the least row_id of a protein, and so of the component.
    return named.groupBy("row_id").agg(F.min("root").alias("group_id"), F.min("label").alias("label"))


def _sizes(grouped: DataFrame) -> DataFrame:
    known = F.col("label").between(0, LABELS - 1)
    parts = [F.count_if(F.col("label") == i).alias(f"n{i}") for i in range(LABELS)]
    return grouped.groupBy("group_id").agg(F.count("*").alias("rows"), *parts, F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def _cost(totals: np.ndarray, target: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared relative deviation, the row counts weighing as much as all labels; totals: (..., 3, WIDTH)."""
    d = (totals - target) / scale
    return (d[..., 0] ** 2).sum(-1) * 4 + (d[..., 1:] ** 2).sum((-2, -1))


def _anneal(sizes: np.ndarray, start: np.ndarray, target: np.ndarray, seeds: list[int], steps: int, warm: float = 0.1) -> np.ndarray:
    """The assignments (chains, n) of components (n, WIDTH) after annealing from `start` towards target (chains, 3, WIDTH).

    Each chain takes its own random steps; they are made side by side. warm: heat at the start, in parts of the cost.
    """
    n, chains = len(sizes), len(start)
    every = np.arange(chains)
    where = start.copy()
    scale = np.maximum(1.0, sizes.sum(0))[None, :]
    totals = np.stack([[sizes[w == s].sum(0) for s in range(3)] for w in where])
    cost = _cost(totals, target, scale)
    best, best_at = cost.copy(), np.zeros(chains, np.int64)
    done: list[list[tuple[int, int, int, int]]] = [[] for _ in seeds]
    draws = [np.random.default_rng(s) for s in seeds]
    one, other = np.stack([r.integers(0, n, steps) for r in draws], 1), np.stack([r.integers(0, n, steps) for r in draws], 1)
    to, luck = np.stack([r.integers(0, 3, steps) for r in draws], 1), np.stack([r.random(steps) for r in draws], 1)
    swap = np.stack([r.random(steps) < 0.4 for r in draws], 1)
    heat, cooling = np.maximum(cost, 1e-12) * warm, 1e-7 ** (1 / steps)
    for k in range(steps):
        i, j = one[k], other[k]
        from_, into = where[every, i], np.where(swap[k], where[every, j], to[k])
        delta = np.where(swap[k][:, None], sizes[j], 0.0) - sizes[i]
        delta[from_ == into] = 0.0
        new = totals.copy()
        new[every, from_] += delta
        new[every, into] -= delta
        cost_new = _cost(new, target, scale)
        take = (from_ != into) & ((cost_new <= cost) | (luck[k] < np.exp(np.minimum(0.0, (cost - cost_new) / heat))))
        heat *= cooling
        if not take.any():
            continue
        totals[take], cost[take] = new[take], cost_new[take]
        for c in np.flatnonzero(take).tolist():
            a, b, x, y = int(i[c]), int(j[c]) if swap[k, c] else -1, int(from_[c]), int(into[c])
            where[c, a] = y
            if b >= 0:
                where[c, b] = x
            done[c].append((a, b, x, y))
            if cost[c] < best[c]:
                best[c], best_at[c] = cost[c], len(done[c])
    for c, moves in enumerate(done):  # back to the best assignment of the way
        for a, b, x, y in reversed(moves[best_at[c] :]):
            where[c, a] = x
            if b >= 0:
                where[c, b] = y
    return where


def _hashed(ids: np.ndarray, seed: int, shares: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.searchsorted(np.cumsum(shares)[:-1], u, side="right")


def splits(grouped: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), chains: int = 6, rounds: int = 4, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """(row_id, group_id, split): every row of `groups` with its split; rows of a group share one.

    shares are of rows; the counts of labels 0, 1, 2 and of rows without one are balanced in the same shares as
    far as possible. The result depends on the rows, the parameters and the number of partitions only, by default one
    for each COMPONENTS components.
    """
    share = np.asarray(shares, float) / sum(shares)
    columns = ["rows", *(f"n{i}" for i in range(LABELS)), "other"]
    sizes = checkpoint(_sizes(grouped))
    n = partitions or max(1, -(-sizes.count() // COMPONENTS))
    # chains: of each component, its split in each chain as a digit.
    state = sizes.repartition(n, "group_id").sortWithinPartitions("group_id")
    state = checkpoint(state.select(F.spark_partition_id().alias("part"), "group_id", *columns, F.lit(None).cast("string").alias("chains"), F.lit(None).cast("array<double>").alias("totals")))
    schema = state.schema.simpleString()[7:-1].replace(":", " ")

    def round_of(shift: dict[int, np.ndarray], turn: int):
        """shift: what is added to the targets (chains, 3, WIDTH) of a partition. A row more has the partition's totals."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            table = table.filter(table.column("group_id").is_valid())
            part, ids = table.column("part")[0].as_py(), table.column("group_id").to_numpy()
            own = np.stack([table.column(c).to_numpy() for c in columns], 1).astype(np.float64)
            if turn:
                start = np.array([list(x) for x in table.column("chains").to_pylist()]).astype(np.int8).T.copy()
            else:
                start = np.stack([_hashed(ids, seed + c, share).astype(np.int8) for c in range(chains)])
            target = share[:, None] * own.sum(0)[None, :] + shift.get(part, np.zeros((chains, 3, WIDTH)))
            seeds = [((seed * 1000 + c) * 1000 + turn) * 100_000 + part for c in range(chains)]
            where = _anneal(own, start, target, seeds, max(LEAST_STEPS, STEPS_EACH * len(ids) >> (2 if turn else 0)), 0.1 if turn == 0 else 0.01)
            totals = np.stack([[own[w == s].sum(0) for s in range(3)] for w in where])
            digits = ["".join(map(str, x)) for x in where.T.tolist()]
            counts = [pa.array(np.append(x, 0).astype(np.int64)) for x in own.T]
            last = [pa.array([part] * (len(ids) + 1), pa.int32()), pa.array([*ids.tolist(), None], pa.int64()), *counts, pa.array([*digits, None]), pa.array([*[None] * len(ids), totals.ravel().tolist()], pa.list_(pa.float64()))]
            yield from pa.table(last, table.column_names).to_batches()

        return f

    best: tuple[float, int, DataFrame] | None = None
    shift: dict[int, np.ndarray] = {}
    for turn in range(rounds):
        state = checkpoint(state.mapInArrow(round_of(shift, turn), schema))
        # One row of chains x 15 numbers for each partition.
        got = {r.part: np.array(r.totals).reshape(chains, 3, WIDTH) for r in state.filter("group_id is null").select("part", "totals").collect()}
        if not got:
            break
        whole = sum(got.values())
        everything = whole[0].sum(0)
        target = share[:, None] * everything[None, :]
        cost = _cost(whole, target, np.maximum(1.0, everything)[None, :])
        top = int(cost.argmin())
        if best is None or cost[top] < best[0]:
            best = (float(cost[top]), top, state)
        if np.abs(whole[top] - target).max() <= max(NEAR_ROWS, NEAR_PART * everything[0]):
            break
        # What is too much or too little is passed on: at first to all by their size, then, as it is but a few
        # rows, which would be lost in rounding, to one partition after the other.
        shift = dict(shift)
        for k, (part, totals) in enumerate(sorted(got.items())):
            weight = totals.sum(1) / np.maximum(everything, 1) if turn == 0 else np.stack([np.full(WIDTH, float(k == (turn + c) % len(got))) for c in range(chains)])
            shift[part] = shift.get(part, 0) + (target[None] - whole) * weight[:, None, :]
    if best is None:
        return grouped.select("row_id", "group_id", F.lit(None).cast("string").alias("split"))
    names = F.array(*(F.lit(x) for x in SPLITS))
    digit = F.substring("chains", best[1] + 1, 1).cast("int")
    chosen = best[2].filter("group_id is not null").select("group_id", F.get(names, digit).alias("split"))
    return grouped.join(chosen, "group_id").select("row_id", "group_id", "split")
