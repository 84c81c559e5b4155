"""Splitting oversized sequences at natural boundaries, with overlap.

Pointer doubling over boundaries: every boundary of a sequence, and its start, is joined to its farthest legal
successor, the last boundary that a piece beginning `overlap` before it can end at. Where no boundary is in
reach the pieces in between end at fixed places, whose number follows from the next boundary alone, so that
the successor is again a boundary. Squaring the successor table (succ = succ[succ]) doubles the reach, and after
log2(cuts) rounds the cuts reachable from the start are known, for all sequences of an Arrow batch at once.
A sequence is one row, so nothing is shuffled; short sequences never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop and gap marks.
MARKS = "*-."
#: All white space of Unicode.
SPACE = r"(?U)\s+"


def cut_points(texts: list[str], longest: np.ndarray, overlap: np.ndarray, marks: str = MARKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all pieces of texts, each longer than its limit. 0 <= overlap < longest."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_mark = np.isin(codes, np.array([ord(c) for c in marks], np.uint32))
    last = is_mark.copy()
    last[:-1] &= ~is_mark[1:]
    last[offsets[1:][lengths > 0] - 1] |= is_mark[offsets[1:][lengths > 0] - 1]
    at = np.flatnonzero(last) + 1  # the position just after a run, over all texts
    row = np.searchsorted(offsets, at - 1, side="right") - 1

    # Nodes: the start of every text (as an end at `overlap`, which makes it begin at 0), then its boundaries.
    node_row = np.concatenate((np.arange(n), row))
    node_at = np.concatenate((overlap, at - offsets[row]))
    keep = np.concatenate((np.ones(n, bool), node_at[n:] > overlap[row]))
    order = np.lexsort((node_at[keep], node_row[keep]))
    node_row, node_at = node_row[keep][order], node_at[keep][order]
    size = len(node_row)
    step = (longest - overlap)[node_row]
    length = lengths[node_row]
    stride = int(max(lengths.max(initial=0), longest.max(initial=0), 1)) + 2
    key = node_row * stride + node_at

    # The next boundary, and how many fixed cuts come before it is in reach; with none, cuts until the rest fits.
    following = np.minimum(np.arange(size) + 1, size - 1)
    has_next = (np.arange(size) + 1 < size) & (node_row[following] == node_row)
    to_end = np.maximum(0, -(-(length - node_at - step) // step))  # pieces that are cut off before the rest fits
    to_next = np.where(has_next, -(-(node_at[following] - node_at) // step) - 1, to_end)
    fixed = np.minimum(np.maximum(to_next, 0), to_end)
    reached = node_at + fixed * step  # the last fixed cut
    ends = (to_end <= fixed) | ~has_next
    # The farthest legal successor: the last node at or before reached + step.
    succ = np.searchsorted(key, node_row * stride + np.minimum(reached + step, stride - 1), side="right") - 1
    succ = np.where(ends, np.arange(size), succ)

    # Squaring: after round k `jump` leads 2**k cuts ahead and `seen` holds the cuts less than 2**k after a start.
    seen = np.zeros(size, bool)
    seen[np.searchsorted(key, np.arange(n) * stride + overlap)] = True
    jump = succ
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more == seen).all():
            break
        seen, jump = more, jump[jump]

    cut = np.flatnonzero(seen)
    pieces = fixed[cut] + 1  # the fixed ones, then the one that ends at the successor or at the text's end
    owner = np.repeat(cut, pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = node_at[owner] + nth * step[owner] - overlap[node_row[owner]]
    final = nth == np.repeat(pieces, pieces) - 1
    target = np.where(ends[owner], length[owner], node_at[succ[owner]])
    end = np.where(final, target, begin + longest[node_row[owner]])
    return node_row[owner], begin, end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("s").to_pylist()
        row, start, end = cut_points(texts, batch.column("longest").to_numpy(), batch.column("overlap").to_numpy())
        total = np.bincount(row, minlength=len(texts))[row]
        yield pa.RecordBatch.from_arrays([batch.column("rec_id").take(pa.array(row)), pa.array(start), pa.array(end), pa.array(total)], ["rec_id", "aa_start", "aa_end", "chunks_total"])


def pieces(records: DataFrame, settings: DataFrame) -> DataFrame:
    """(rec_id, aa_start, aa_end, chunks_total): the pieces of each sequence longer than its limit.

    records: rec_id, seq, backbone. settings: backbone (unique), chunk_len, chunk_overlap (0 <= overlap < len,
    else an error). Positions are 0-based, half-open and count all characters but white space. A natural
    boundary is just after a run of `*`, `-` and `.`, as long as it goes. While more than chunk_len characters
    are left from a piece's start on, it ends at the last boundary more than chunk_overlap and at most chunk_len
    after its start, or, without one, exactly chunk_len after it; the next piece starts chunk_overlap before.
    Null, empty and short sequences, and backbones that are null or have no settings, give no rows; repeated
    rec_ids are split each for itself; other columns are ignored.
    """
    limits = settings.select(
        F.col("backbone").alias("backbone"),
        F.col("chunk_len").cast("bigint").alias("longest"),
        F.col("chunk_overlap").cast("bigint").alias("overlap"),
    ).filter("longest is not null and overlap is not null")
    checked = limits.withColumn(
        "longest", F.when((F.col("overlap") >= 0) & (F.col("overlap") < F.col("longest")), F.col("longest")).otherwise(F.raise_error(F.lit("chunk_overlap must be at least 0 and less than chunk_len")))
    )
    long = (
        records.select(F.col("rec_id").cast("bigint").alias("rec_id"), "backbone", F.regexp_replace("seq", SPACE, "").alias("s"))
        .join(checked, "backbone")
        .filter(F.length("s") > F.col("longest"))
        .select("rec_id", "s", "longest", "overlap")
    )
    return long.mapInArrow(_split, "rec_id bigint, aa_start bigint, aa_end bigint, chunks_total bigint")
