"""Vectors of exported entries: reading, lossless packing, a bounded sample, and routing to overlapping cells.

Neighbours and clusters are both found in two levels. Trees that are fitted on a bounded sample send every vector to
its cells, and to cells next to them when it lies near a boundary. A node is divided until its estimated rows fit into a
cell, however large the table; where too few rows of the sample are left to fit a division, it is laid by the shape of
the node above. Within a cell a tree of the same kind, fitted on all its rows, makes leaves in which vectors are
compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Vectors of the sample that the routing trees are fitted on.
SAMPLE = 50_000
#: Rows of the sample that a division of a node is fitted on at least.
LEAST_FIT = 48

#: Of n vectors, the (cell, row) of every visit.
Route = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def entries(df: DataFrame, pool: str = "backbone", kind: str = "span_attn_norm", width: int = WIDTH) -> DataFrame:
    """(entry_id, v): the rows with an id and a vector of the right length; numbers are looked at in `unit`."""
    v = F.try_element_at(F.try_element_at(F.col("pools"), F.lit(pool)), F.lit(kind))
    return df.select(F.col("entry_id").cast("bigint").alias("entry_id"), v.alias("v")).filter((F.size("v") == width) & F.col("entry_id").isNotNull())


def matrix(column: pa.ListArray, kind: type = np.float32) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, WIDTH), kind)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(v: np.ndarray) -> np.ndarray:
    return np.isfinite(v).all(1) & (v != 0).any(1)


def pack(v: np.ndarray) -> list[bytes]:
    """Each row as bytes without loss: of half precision where that holds every number, else of single precision."""
    with np.errstate(over="ignore"):
        half = v.astype(np.float16)
    exact = (half.astype(np.float32) == v).all(1)
    return [h.tobytes() if e else x.tobytes() for e, h, x in zip(exact.tolist(), half, v)]


def unpack(packed: list[bytes]) -> np.ndarray:
    out = np.empty((len(packed), WIDTH), np.float32)
    size = np.fromiter(map(len, packed), np.int64, len(packed))
    for kind, width in ((np.float16, 2 * WIDTH), (np.float32, 4 * WIDTH)):
        at = np.flatnonzero(size == width)
        if len(at):
            out[at] = np.frombuffer(b"".join([packed[i] for i in at]), kind).reshape(-1, WIDTH)
    return out


def sample(df: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Unit vectors of about `most` entries, drawn by a hash of the id, and the number of rows of df."""
    rows = df.count()
    one_in = max(1, -(-rows // most))
    drawn = df.filter(F.pmod(F.xxhash64("entry_id", F.lit(5)), F.lit(one_in)) == 0).limit(2 * most).toArrow()
    if not drawn.num_rows:
        return np.empty((0, WIDTH), np.float32), rows
    v = matrix(drawn.column("v").combine_chunks())
    return unit(v[usable(v)]).astype(np.float32), rows


class Blocks:
    """All pairs: vectors are dealt into blocks by their bits, and each two blocks are a cell."""

    def __init__(self, rows: int, cell_rows: int, start: int = 0):
        self.blocks = 1 if rows <= cell_rows else int(np.ceil(2 * rows / cell_rows))
        self.start, self.end = start, start + self.blocks * self.blocks

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.blocks == 1:
            return np.full(len(x), self.start), np.arange(len(x))
        bits = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
        block = (((bits * np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64)).sum(1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.blocks)).astype(np.int64)[:, None]
        other = np.arange(self.blocks)[None, :]
        cell = self.start + np.minimum(block, other) * self.blocks + np.maximum(block, other)
        row, at = np.nonzero(block != other)
        return cell[row, at], row


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the true places; of a matrix with few of them several times as fast as np.nonzero."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def grouped(cell: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, its rows) of visits."""
    order = np.argsort(cell, kind="stable")
    cell, row = cell[order], row[order]
    cuts = np.flatnonzero(np.diff(cell)) + 1
    for at in np.split(np.arange(len(cell)), cuts) if len(cell) else ():
        yield int(cell[at[0]]), row[at]


def route(df: DataFrame, cells: Route, copies: int) -> DataFrame:
    """(cell, ids, vec): each vector once a cell that it visits, the ids of a batch's entries with this vector together.

    Of the entries of a batch with one vector, `copies` go on with it (at least k + 1 where k neighbours are looked
    for). Rows with an empty vec hold the others, which follow their first id. So a group of copies sends one vector a
    batch, and its ids travel in groups of at most a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            ok = usable(v)
            v, ids = v[ok], batch.column("entry_id").to_numpy(zero_copy_only=False)[ok]
            if not len(v):
                continue
            packed = pack(v)
            groups: dict[bytes, int] = {}
            of = np.array([groups.setdefault(p, len(groups)) for p in packed])
            first = np.unique(of, return_index=True)[1]
            names: list[bytes] = []
            extra: list[bytes] = []
            if len(first) == len(of):
                names = [x.tobytes() for x in ids.astype(np.int64).reshape(-1, 1)]
            else:
                order = np.lexsort((ids, of))
                for part in np.split(ids[order], np.flatnonzero(np.diff(of[order])) + 1):
                    own = np.unique(part).astype(np.int64)
                    names.append(own[:copies].tobytes())
                    if len(own) > copies:
                        extra.append(np.concatenate((own[:1], own[copies:])).tobytes())
            vec = [packed[i] for i in first]
            cell, where = cells(unit(v[first]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((cell.astype(np.int32), np.full(len(extra), -1, np.int32)))),
                    pa.array([*(names[i] for i in where), *extra], pa.binary()),
                    pa.array([*(vec[i] for i in where), *[b""] * len(extra)], pa.binary()),
                ],
                ["cell", "ids", "vec"],
            )

    return df.mapInArrow(run, "cell int, ids binary, vec binary")


def spread(routed: DataFrame) -> DataFrame:
    """Rows that only follow are spread over all tasks, as no cell has to see them."""
    return routed.withColumn("cell", F.when(F.col("cell") >= 0, F.col("cell")).otherwise(-1 - F.pmod(F.xxhash64("ids"), F.lit(4096)).cast("int")))


def classes(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a cell: the distinct vectors, the sorted ids of each, and the groups of ids that follow their first."""
    found: dict[bytes, list[bytes]] = {}
    follow = []
    for ids, vec in zip(table.column("ids").to_pylist(), table.column("vec").to_pylist()):
        if vec:
            found.setdefault(vec, []).append(ids)
        else:
            follow.append(np.frombuffer(ids, np.int64))
    ids = [np.frombuffer(x[0], np.int64) if len(x) == 1 else np.unique(np.frombuffer(b"".join(x), np.int64)) for x in found.values()]
    return unpack(list(found)), ids, follow
