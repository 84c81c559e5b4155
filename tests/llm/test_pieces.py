import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.pieces import cut_points, pieces


def brute(s, longest, overlap):
    ends = [i + 1 for i, c in enumerate(s) if c in "*-." and (i + 1 == len(s) or s[i + 1] not in "*-.")]
    out, start = [], 0
    while len(s) - start > longest:
        near = [e for e in ends if start + overlap < e <= start + longest]
        end = near[-1] if near else start + longest
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(s))]


@given(st.lists(st.tuples(st.text("AC*-.é", min_size=12, max_size=120), st.integers(0, 9)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_like_greedy(items):
    texts = [t for t, _ in items]
    longest, overlap = np.full(len(texts), 11), np.array([o for _, o in items])
    row, start, end = cut_points(texts, longest, overlap)
    got = [[] for _ in texts]
    for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
        got[r].append((s, e))
    assert got == [brute(t, 11, o) for t, o in items]


def test_rows(spark):
    rng = random.Random(3)
    seqs = {i: "".join(rng.choice("ACDEFG" * 6 + "*-. \n\t") for _ in range(rng.choice([5, 99, 100, 101, 180, 2500]))) for i in range(60)}
    seqs |= {100: None, 101: "", 102: "   \n", 103: "A" * 30_000, 104: "*" * 500, 105: "A" * 99 + "*" + "A" * 300, 106: "A" * 1000}
    rows = [(i, s, {105: "b", 106: "unknown"}.get(i, "a"), "x", 1) for i, s in seqs.items()] + [(107, "A" * 500, None, "x", 1)]
    settings_ = spark.createDataFrame([("a", 100, 10, "q"), ("b", 100, 0, "q"), ("c", None, 3, "q")], "backbone string, chunk_len int, chunk_overlap int, s string")
    got = {}
    for r in pieces(spark.createDataFrame(rows, "rec_id bigint, seq string, backbone string, s string, longest int").repartition(3), settings_).collect():
        got.setdefault(r.rec_id, []).append((r.aa_start, r.aa_end, r.chunks_total))
    want = {}
    for i, s, b, *_ in rows:
        clean = "".join((s or "").split())
        if b in ("a", "b") and len(clean) > 100:
            parts = brute(clean, 100, 10 if b == "a" else 0)
            want[i] = [(x, y, len(parts)) for x, y in parts]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(y - x <= 100 for v in got.values() for x, y, _ in v)


def test_empty_and_bad_settings(spark):
    none = spark.createDataFrame([], "rec_id bigint, seq string, backbone string")
    good = spark.createDataFrame([("a", 10, 2)], "backbone string, chunk_len int, chunk_overlap int")
    assert pieces(none, good).collect() == []
    bad = spark.createDataFrame([("a", 10, 10)], "backbone string, chunk_len int, chunk_overlap int")
    with pytest.raises(Exception, match="chunk_overlap"):
        pieces(spark.createDataFrame([(1, "A" * 50, "a")], "rec_id bigint, seq string, backbone string"), bad).collect()
