"""Nearest vectors and clusters against brute force, with copies, ties and unusable vectors."""

import numpy as np
import pytest

from seqloom.llm import clusters as C
from seqloom.llm import neighbours as N
from seqloom.llm.vectors import pack, unpack

SCHEMA = "entry_id bigint, pools map<string, map<string, array<float>>>, v string, cell int, ids bigint, root bigint"


def make(seed, n=900):
    rng = np.random.default_rng(seed)
    vectors = {}
    i = 0
    while i < n:
        centre = rng.normal(size=64)
        size = int(rng.choice([1, 1, 2, 3, 8, 60]))
        for _ in range(size):
            i += 1
            vectors[i * 3] = ((centre / np.linalg.norm(centre) + rng.normal(size=64) * rng.choice([0.01, 0.03, 0.045])) * rng.choice([1, 1, 0.2, 8])).astype(np.float32)
    hot = rng.normal(size=64).astype(np.float32)
    for k in range(300):  # very many copies of one vector, and a scaled one
        vectors[10_000 + k] = hot
    vectors[9_000] = hot * 2
    bad = {20_001: None, 20_002: [], 20_003: [1.0] * 63, 20_004: [0.0] * 64, 20_005: [float("nan")] + [1.0] * 63, 20_006: [float("inf")] + [1.0] * 63, 20_007: [None] + [1.0] * 63}
    rows = [(k, {"backbone": {"span_attn_norm": v.tolist(), "full_mean": None}}, "x", 1, 2, 3) for k, v in vectors.items()]
    rows += [(k, {"backbone": {"span_attn_norm": v}}, "x", 1, 2, 3) for k, v in bad.items()]
    rows += [(20_010, None, "x", 1, 2, 3), (20_011, {}, "x", 1, 2, 3), (20_012, {"input": {"span_attn_norm": [1.0] * 64}}, "x", 1, 2, 3), (None, rows[0][1], "x", 1, 2, 3)]
    order = rng.permutation(len(rows))
    return vectors, [rows[j] for j in order] + rows[:40]


def cosines(vectors):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 6)
    np.fill_diagonal(c, -1)
    return ids, c


def true_pairs(vectors, k=5, least=0.9):
    ids, c = cosines(vectors)
    out = set()
    for i in range(len(ids)):
        near = np.flatnonzero(c[i] >= least)
        for j in near[np.lexsort((ids[near], -c[i][near]))][:k]:
            out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def true_clusters(vectors, least=0.9):
    ids, c = cosines(vectors)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root, np.where(c >= least, root[None], len(ids)).min(1))
        if (low == root).all():
            break
        root = low
    counts = np.bincount(root, minlength=len(ids))
    return {(int(ids[i]), int(ids[root[i]])) for i in range(len(ids)) if counts[root[i]] > 1}


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 64)).astype(np.float32)
    v[::2] = v[::2].astype(np.float16)
    v[3, 0] = 1e30
    p = pack(v)
    assert {len(x) for x in p} == {128, 256}
    assert (unpack(p) == v).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest(spark, seed):
    vectors, rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = true_pairs(vectors)
    got = {(r.entry_a, r.entry_b) for r in N.pairs(N.most_similar(df)).collect()}  # one cell
    assert got == want
    split = {(r.entry_a, r.entry_b) for r in N.pairs(N.most_similar(df, cell_rows=200)).collect()}
    # cells of 200 rows divide clusters whose members are hardly within the limit
    assert len(split & want) >= 0.95 * len(want)
    assert len(split & want) >= 0.95 * len(split)


def test_tables_within_a_cell():
    vectors, _ = make(3, 6000)
    ids = np.array(sorted(vectors))
    v = np.array([vectors[i] for i in ids])
    first = np.unique(v, axis=0, return_index=True)[1]
    v, ids = v[first], ids[first]
    a, _, b = N.best_of_cell(v, [ids[i : i + 1] for i in range(len(ids))], 5, 0.9)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = true_pairs(dict(zip(ids.tolist(), v)))
    assert len(v) > N.FEW_ROWS
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    vectors, rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = true_clusters(vectors)
    assert {(r.entry_id, r.cluster_id) for r in C.clusters(df).collect()} == want
    split = {(r.entry_id, r.cluster_id) for r in C.clusters(df, cell_rows=200).collect()}
    assert len(split & want) >= 0.99 * len(want)


def test_leaf_that_does_not_divide():
    rng = np.random.default_rng(4)
    x = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(n, 64)) * 0.02 for c, n in ((rng.normal(size=64), 3000), (rng.normal(size=64), 1500), (rng.normal(size=64), 1))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = C._leaf_labels(x.astype(np.float32), x, 0.9)
    assert len(x) > 4 * C.LEAF_ROWS
    assert (label[:3000] == 0).all() and (label[3000:4500] == 3000).all() and label[4500] == -1


def test_description(spark):
    vectors, rows = make(1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.clusters(df)
    out = {r.cluster_id: r for r in C.describe(df, found).collect()}
    members = {}
    for e, c in true_clusters(vectors):
        members.setdefault(c, []).append(e)
    assert {c: r["size"] for c, r in out.items()} == {c: len(m) for c, m in members.items()}
    for c, m in members.items():
        x = np.array([vectors[i] for i in sorted(m)], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(0)
        near = np.round(x @ centre / np.linalg.norm(centre), 9)
        best = [i for _, i in sorted(zip(-near, sorted(m)))][:3]
        assert out[c].typical == best


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.clusters(none).collect() == []
    assert N.pairs(N.most_similar(none)).collect() == []


def test_description_of_large_clusters(spark):
    """The same from sums of batches, and with an entry whose rows differ."""
    vectors, rows = make(2)
    rows.append((rows[0][0], {"backbone": {"span_attn_norm": [3.0] * 64}}, "x", 1, 2, 3))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = spark.createDataFrame(sorted(true_clusters(vectors)), "entry_id bigint, cluster_id bigint")
    whole = sorted(map(repr, C.describe(df, found).collect()))
    assert whole == sorted(map(repr, C.describe(df.repartition(5), found, most=20).collect()))
    assert C.describe(df, found.filter("entry_id < 0")).collect() == []


def test_exact_and_larger_k(spark):
    """All pairs in blocks, and more neighbours than copies of a vector that a batch sends."""
    vectors, rows = make(1, 500)
    twin = np.random.default_rng(9).normal(size=64).astype(np.float32)
    for k in range(20):
        vectors[30_000 + k] = twin
        rows.append((30_000 + k, {"backbone": {"span_attn_norm": twin.tolist()}}, "x", 1, 2, 3))
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = true_pairs(vectors, 10)
    assert {(r.entry_a, r.entry_b) for r in N.pairs(N.most_similar(df, k=10), 10).collect()} == want
    assert {(r.entry_a, r.entry_b) for r in N.pairs(N.most_similar(df, k=10, cell_rows=150, exact=True), 10).collect()} == want
    assert {(r.entry_id, r.cluster_id) for r in C.clusters(df, cell_rows=150, exact=True).collect()} == true_clusters(vectors)


def test_cells_stay_bounded_beyond_the_sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for cells in (N.StableTree(x[:500], 400, 1, 0.0, len(x)), C.BisectingTree(x[:500], 400, 1, 0.0, rows=len(x))):
        cell, row = cells(x)
        assert len(row) == len(x)
        size = np.bincount(cell)
        assert size.max() <= 5 * 400 and len(x) / (size > 0).sum() <= 400


def test_visits_in_order_of_success():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5_000, 64)).astype(np.float32)
    wide, one = N.StableTree(x, 200, 1, 1.0), N.StableTree(x, 200, 1, 0.0)
    leaf, row = wide(x)
    assert np.bincount(row).max() <= N.PROBES < len(leaf) / 100
    first = np.flatnonzero(np.diff(row, prepend=-1))
    home_leaf, home_row = one(x)
    assert (leaf[first] == home_leaf).all() and (row[first] == home_row).all()


def test_no_link_of_a_cell_is_missed():
    """A long chain whose ends are far apart, among single vectors."""
    rng = np.random.default_rng(7)
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    chain = np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.449)])
    x = np.concatenate((chain, rng.normal(size=(3000, 64)))).astype(np.float32)
    order = rng.permutation(len(x))
    ids = [np.array([i]) for i in range(len(x))]
    entry, root = C.cell_components(x[order], ids, 0.9, most=20)
    at = {int(o): i for i, o in enumerate(order)}
    want = {at[i] for i in range(len(chain))}
    assert {int(e) for e, r in zip(entry, root) if r == min(want)} == want


def test_leaves(spark):
    vectors, rows = make(1)
    got = C.leaves(spark.createDataFrame(rows, SCHEMA).repartition(3), cell_rows=300).collect()
    assert sorted(r.entry_id for r in got) == sorted(vectors)
    members = {}
    for r in got:
        members.setdefault(r.cluster_id, []).append(r.entry_id)
    for name, m in members.items():
        x = np.array([vectors[i] for i in m], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(0)
        assert name == min(m) and (x @ centre / np.linalg.norm(centre)).min() >= 0.9 - 1e-5
    assert C.leaves(spark.createDataFrame([], SCHEMA)).collect() == []
