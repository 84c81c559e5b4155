"""Nearest vectors in a dense group of different vectors that holds a third of the rows."""

import numpy as np

from seqloom.llm import neighbours as N

SCHEMA = "entry_id bigint, pools map<string, map<string, array<float>>>"


def make(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    centre = rng.normal(size=64)
    x[: n // 3] = centre / np.linalg.norm(centre) + rng.normal(size=(n // 3, 64)) * np.sqrt(0.075 / 64)
    return x.astype(np.float32)[rng.permutation(n)]


def true_pairs(x, k=5, least=0.9):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -1)
    best = np.argsort(-c, axis=1, kind="stable")[:, :k]
    return {(min(i, j), max(i, j)) for i in range(len(x)) for j in best[i].tolist() if c[i, j] >= least}


def test_within_a_cell():
    x = make(6000)
    a, _, b = N.best_of_cell(x, [np.array([i]) for i in range(len(x))], 5, 0.9)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == true_pairs(x)


def test_across_cells(spark):
    x = make(4500)
    df = spark.createDataFrame([(i, {"backbone": {"span_attn_norm": v.tolist()}}) for i, v in enumerate(x)], SCHEMA).repartition(3)
    assert {(r.entry_a, r.entry_b) for r in N.pairs(N.most_similar(df, cell_rows=700)).collect()} == true_pairs(x)
