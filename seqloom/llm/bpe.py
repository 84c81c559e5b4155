"""Encoding with a byte-level BPE vocabulary, in numpy.

The distinct pieces of a batch of texts are sorted into buckets by length. Each bucket is a padded matrix of
token ids; in every round each row merges its leftmost pair of least rank, found through a hashed pair table,
and the matrix is compacted by the one column that each row lost. Rows without a pair left are done. A round costs as
much as its matrix is wide, so the few pieces of more than LONG bytes are merged in the same order by a heap of pairs
over a linked list, in n log n.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts a text into pieces before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Bytes of a piece from which on it is merged by a heap.
LONG = 2048
#: Characters of text handled at a time, distinct pieces kept between batches, and the longest piece kept.
BLOCK_CHARS, MOST_KEPT, LONGEST_KEPT = 4_000_000, 300_000, 48
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or one from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Open addressing from a pair of ids to (rank, merged id); lookups are vectorised."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int64)
        self.merged = np.append(merged, 0).astype(np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(waiting):
            at = slot[waiting]
            free = self.keys[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]] = keys[waiting[placed]]
            self.values[at[placed]] = waiting[placed]
            waiting = np.delete(waiting, placed)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that don't merge; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.values[slot[hit]]
        open_ = np.flatnonzero(~hit & (found >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class ByteBPE:
    def __init__(self, path: str = DEFAULT_PATH):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int32)
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        self.merged = self.pairs.merged.tolist()
        self.ranks: dict[int, int] | None = None
        self.find = regex.compile(PIECES).findall
        self.kept: dict[str, np.ndarray] = {}

    def encode_pieces(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each piece; every piece has at least one byte."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        bucket = np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64)
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            width = int(lengths[rows].max())
            if width > LONG:
                for r in rows:
                    out[r] = self._merge_long(self.bytes[np.frombuffer(raw[r], np.uint8)])
                continue
            most = max(1, 4_000_000 // width)
            for i in range(0, len(rows), most):
                self._merge(rows[i : i + most], [raw[r] for r in rows[i : i + most]], lengths[rows[i : i + most]], width, out)
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The ids after all merges of one piece, the leftmost pair of least rank first."""
        if self.ranks is None:
            used = self.pairs.keys >= 0
            self.ranks = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist()))
        rank_of, merged, none = self.ranks.get, self.merged, int(NONE)
        n = len(ids)
        ranks = self.pairs.rank(ids[:-1], ids[1:]).tolist()
        token, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank != none]
        ranks.append(none)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if ranks[i] != rank:  # its tokens have been merged since
                continue
            gone = after[i]
            token[i] = own = merged[rank]
            following = after[i] = after[gone]
            ranks[gone], token[gone] = -1, -1
            if following < n:
                before[following] = i
                ranks[i] = now = rank_of(own << 32 | token[following], none)
                if now != none:
                    push(heap, now << 32 | i)
            else:
                ranks[i] = none
            left = before[i]
            if left >= 0:
                ranks[left] = now = rank_of(token[left] << 32 | own, none)
                if now != none:
                    push(heap, now << 32 | left)
        done = np.array(token, np.int32)
        return done[done >= 0]

    def _merge(self, rows: np.ndarray, raw: list[bytes], lengths: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        lengths = lengths.copy()
        while len(rows):
            if ranks.shape[1] == 0:
                at, least = None, np.full(len(rows), NONE)
            else:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : lengths[i]].copy()
                live = ~done
                if not live.any():
                    return
                rows, ids, ranks, lengths, at, least = rows[live], ids[live], ranks[live], lengths[live], at[live], least[live]
            n, every = len(rows), np.arange(len(rows))
            ids[every, at] = self.pairs.merged[least]
            lengths -= 1
            # Compaction: each row loses the right token of its pair, and the rank of the pair itself.
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, -1)
            keep = np.ones(ranks.shape, bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, -1)
            if ranks.shape[1]:
                # The pairs to the left and to the right of the merged token are new.
                with_left, with_right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
                row, col = np.concatenate((with_left, with_right)), np.concatenate((at[with_left] - 1, at[with_right]))
                ranks[row, col] = self.pairs.rank(ids[row, col], ids[row, col + 1])
            longest = int(lengths.max())
            if longest < ids.shape[1]:
                ids, ranks = ids[:, :longest], ranks[:, : longest - 1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        index: dict[str, int] = {}
        place, words = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.find(text)
                words[i] = len(found)
                place += [index.setdefault(w, len(index)) for w in found]
        if not place:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        kept = self.kept
        missing = [w for w in index if w not in kept]
        fresh = dict(zip(missing, self.encode_pieces(missing)))
        parts = [fresh[w] if w in fresh else kept[w] for w in index]
        if len(kept) + len(fresh) > MOST_KEPT:
            kept.clear()
        kept.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST_KEPT)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(size) - size
        flat, at = np.concatenate(parts), np.array(place)
        each = size[at]
        total = np.cumsum(each)
        ids = flat[np.repeat(begin[at] - (total - each), each) + np.arange(int(total[-1]))]
        ends = np.concatenate(([0], total))[np.cumsum(words)]
        return ids, np.diff(ends, prepend=0)


#: One encoder for each vocabulary and Python worker.
_ENCODERS: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of characters each, but for single longer texts."""
    size = np.cumsum([len(x or "") for x in batch.column("text").to_pylist()]) // BLOCK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(key, ids ARRAY<INT>): one row for each row of df, its text encoded without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts both have an empty list. Rows
    with repeated or null keys keep their rows; other columns are ignored. Lone surrogates become `?`. Texts are
    encoded whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in _blocks(batch):
                ids, counts = bpe.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], [key, "ids"])

    rows = df.selectExpr(f"`{key}` as key", f"cast(`{text}` as string) as text")
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(keys, tokens BIGINT): the number of ids of each row's text; 0 for empty and null ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in _blocks(batch):
                counts = bpe.encode(part.column("text").to_pylist())[1]
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keys))), pa.array(counts, pa.int64())], [*keys, "tokens"])

    rows = df.selectExpr(*(f"`{k}` as k{i}" for i, k in enumerate(keys)), f"cast(`{text}` as string) as text")
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))]
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "tokens bigint"]))
