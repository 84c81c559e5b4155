"""Operators against plain Python, with nulls, ties, empty tables and clashing names."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import numeric as N
from seqloom.functions import text as T
from seqloom.operators import evidence, graph, intervals, metrics, model, pooling, ranking, sampling, stats, windows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    x = lambda v: F.lit(v).cast("string")
    assert one(spark, T.sanitised(x("acd b*\n-X")), T.fixed_count(x("acd b*\n-X"))) == ("ACDXXXX", 3)
    assert one(spark, T.sanitised(x(None)), T.fixed_count(x(None)), T.sanitised(x(""))) == (None, None, "")
    assert one(spark, T.storage_key(x(" a|b/c ")), T.storage_key(x(None)), T.storage_key(x("   "))) == ("a_b_c", "unnamed", "unnamed")
    assert len(one(spark, T.safe_id(x("a b" * 100), 40))[0]) == 40
    assert one(spark, *(T.base_id(x(v)) for v in ("a|chunk_1|chunk_2", "a_chunk_1", "a", "a_chunk_1|chunk_2"))) == ("a|chunk_1"[:1], "a", "a", "a_chunk_1")
    got = one(spark, T.parsed_chunk(x("p|q|chunk_0002_of_0010|aa_000100_000400")), T.parsed_chunk(x("p_chunk_3_of_4")), T.parsed_chunk(x("p")))
    assert [tuple(g) for g in got] == [("p|q", 2, 10, 100, 400), ("p", 3, 4, None, None), (None,) * 5]
    assert one(spark, T.to_integer(x("3.7")), T.to_integer(x("-")), T.to_integer(x("x")), T.to_number(x(" 1e-3 "))) == (3, None, None, 0.001)
    assert one(spark, T.key_values(x("a=1\tb\tc = 2 \ta=3")))[0] == {"a": "3", "c": "2"}
    assert tuple(one(spark, T.window_bounds(x("w_window_10_21")))[0]) == (10.0, 21.0, 15.5)
    assert tuple(one(spark, T.window_bounds(x("none")))[0]) == (None, None, None)


def test_fold_is_the_hash(spark):
    import hashlib

    ids = [f"id{i}" for i in range(50)] + [""]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    want = {i: int.from_bytes(hashlib.sha1(f"3\t{i}".encode()).digest()[:8], "big") % 7 for i in ids}
    assert {r.id: r.f for r in df.select("id", T.fold_of(F.col("id"), 7, 3).alias("f")).collect()} == want


def test_half_even(spark):
    got = one(spark, *(N.span_index(F.lit(v), F.lit(6)) for v in (0.1, 0.3, 0.5, 0.7, -1.0, 2.0)))
    assert list(got) == [0, 2, 2, 4, 0, 5]


def test_numeric_edges(spark):
    v = lambda *a: F.array(*map(F.lit, a)) if a else F.array().cast("array<double>")
    assert one(spark, N.l2_normalised(v(0.0, 0.0)), N.l2_normalised(v(3.0, 4.0))) == ([0.0, 0.0], [0.6, 0.8])
    assert one(spark, N.masked_softmax(v(1.0, 2.0), v(False, False)))[0] == [0.0, 0.0]
    assert one(spark, N.span_iou(*map(F.lit, (0.0, 0.0, 0.0, 0.0))), N.span_iou(*map(F.lit, (0.0, 0.5, 0.25, 0.75)))) == (0.0, pytest.approx(1 / 3))
    assert one(spark, N.positions(F.lit(0)), N.positions(F.lit(1)), N.positions(F.lit(3)), N.positions(F.lit(2), False)) == ([], [0.0], [0.0, 0.5, 1.0], [0.0, 0.5])
    assert one(spark, N.evalue_score(F.lit(None).cast("double")), N.evalue_score(F.lit(0.0))) == (0.0, 300.0)
    assert sum(N.gaussian_kernel(1.5)) == pytest.approx(1) and N.gaussian_kernel(0) == [1.0]
    w = [0.1, 0.4, 0.1, 0.3, 0.1]
    got = one(spark, N.shortest_mass(v(*w), 0.75))[0]
    assert (got.l, got.r) == model.hpd(np.array(w), 0.75)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.floats(0.05, 1.0))
@settings(max_examples=200, deadline=None)
def test_shortest_span(raw, mass):
    w = np.array(raw, float)
    if w.sum() == 0:
        return
    w /= w.sum()
    every = [(r - l, l, r) for l in range(len(w)) for r in range(l, len(w)) if w[l : r + 1].sum() >= mass - 1e-12]
    found = model.hpd(w, mass)
    if not every:
        assert found is None
    else:
        assert found is not None and w[found[0] : found[1] + 1].sum() >= mass - 1e-9
        assert found[1] - found[0] == min(every)[0]


def covered(rows, closed):
    out = {}
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            out.setdefault(k, set()).update(range(s, e + closed))
    return out


@pytest.mark.parametrize("closed", [0, 1])
def test_interval_sets(spark, closed):
    rng = random.Random(closed)
    make = lambda n: [(rng.choice("ab"), s, rng.choice([s + rng.randrange(9), None] if rng.random() < 0.1 else [s + rng.randrange(9)])) for s in (rng.randrange(120) for _ in range(n))]
    ra, rb = make(30), make(30)
    schema = "k string, s int, e int"
    a, b = spark.createDataFrame(ra, schema), spark.createDataFrame(rb, schema)
    ca, cb = covered(ra, closed), covered(rb, closed)
    got = {r.k: r.length for r in intervals.union_length(a, ["k"], touch=closed).collect()}
    assert got == {k: len(v) for k, v in ca.items() if v or True}
    both = covered([(r.k, r.s, r.e) for r in intervals.intersection(a, b, ["k"], closed, 16).collect()], closed)
    assert {k: v for k, v in both.items() if v} == {k: v for k in "ab" if (v := ca.get(k, set()) & cb.get(k, set()))}
    if closed:
        keys = spark.createDataFrame([("a",), ("b",), ("none",)], "k string")
        iou = {r.k: r.iou for r in intervals.set_iou(a, b.filter("k = 'a'"), ["k"], keys).collect()}
        assert iou["none"] == 1.0 and iou["b"] == 0.0
        assert iou["a"] == pytest.approx(len(ca["a"] & cb["a"]) / len(ca["a"] | cb["a"]))


def test_lanes(spark):
    rows = [("a", 0, 1, 5), ("a", 1, 2, 3), ("a", 2, 4, 9), ("a", 3, 6, 7), ("b", 4, 1, 1), ("a", 5, None, 2)]
    got = {r.ord: r.lane for r in intervals.pack_lanes(spark.createDataFrame(rows, "k string, ord int, s int, e int"), "k").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_average_precision_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randrange(6)), rng.random() < 0.3) for _ in range(200)] + [("c", 1.0, False), ("c", None, True), ("c", float("nan"), True)]
    df = spark.createDataFrame(rows, "k string, x double, y boolean")
    counts = metrics.score_counts(df, ["k"], "x", F.col("y"))
    ap = {r.k: r.ap for r in metrics.average_precision(counts, ["k"]).collect()}
    auc = {r.k: r.auc for r in metrics.roc_auc(counts, ["k"]).collect()}
    for k in "ab":
        own = [(x, y) for g, x, y in rows if g == k]
        pos = sum(y for _, y in own)
        want, before = 0.0, 0
        for t in sorted({x for x, _ in own}, reverse=True):
            tp, n = sum(y for x, y in own if x >= t), sum(x >= t for x, _ in own)
            want += tp / n * (tp - before) / pos
            before = tp
        assert ap[k] == pytest.approx(want)
        pairs = [(a > b) + 0.5 * (a == b) for (a, ya), (b, yb) in itertools.product(own, own) if ya and not yb]
        assert auc[k] == pytest.approx(sum(pairs) / len(pairs))
    assert ap["c"] == 0.0 and auc["c"] is None


def test_operating_points(spark):
    scores = spark.createDataFrame([("s", float(v)) for v in (1, 2, 2, 3, 9)] + [("s", float("inf")), ("s", float("nan"))], "k string, v double")
    sizes = spark.createDataFrame([("s", 10)], "k string, n int")
    curve = metrics.threshold_fpr(scores, sizes, ["k"], "v", F.lit(False))
    targets = spark.createDataFrame([(0.05,), (0.2,), (0.45,), (0.0,)], "target double")
    got = {r.target: (r.threshold, round(r.fpr, 6), r.source) for r in metrics.operating_points(curve, ["k"], targets, F.lit(False)).collect()}
    assert got == {0.05: (math.nextafter(9.0, math.inf), 0.0, "boundary"), 0.2: (3.0, 0.2, "data"), 0.45: (2.0, 0.4, "data"), 0.0: (math.nextafter(9.0, math.inf), 0.0, "boundary")}


def test_temperature(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 3
    y = rng.random(4000) < 1 / (1 + np.exp(-z / 2.5))
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": y}))
    assert metrics.calibrate_temperature(df, "z", F.col("y")) == pytest.approx(2.5, rel=0.15)


def test_dedupe_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0.5, 1), ("a", [3.0, 4.0], float("nan"), 2), ("b", [5.0, 6.0], None, 3)], "k string, v array<double>, p double, o int")
    first = {m: {r.k: (r.o, r.v) for r in ranking.deduplicate_vectors(df, "k", "v", "p", F.asc("o"), m).collect()} for m in ("none", "maxP", "mean")}
    assert first["maxP"] == {"a": (1, [1.0, 2.0]), "b": (3, [5.0, 6.0])}
    assert first["mean"] == {"a": (1, [2.0, 3.0]), "b": (3, [5.0, 6.0])}


def test_pools(spark):
    vectors, w = [[1.0, 0.0], [0.0, 2.0], [4.0, 4.0]], [1.0, 1.0, 2.0]
    df = spark.createDataFrame([(vectors, w), (vectors, [0.0] * 3), ([], [])], "v array<array<double>>, w array<double>")
    got = [r[0] for r in df.select(pooling.weighted_pool(F.col("v"), F.col("w"))).collect()]
    assert got[0] == [9 / 4, 10 / 4] and got[1] == pytest.approx([5 / 3, 2.0]) and got[2] is None
    assert [r[0] for r in df.select(pooling.top_positions(F.col("w"), 2)).collect()] == [[2, 0], [0, 1], []]
    assert [r[0] for r in df.select(pooling.top_positions(F.col("w"), 0)).collect()][:2] == [[2], [0]]


@pytest.mark.parametrize("mode", ["package", "grid"])
def test_windows(spark, mode):
    lengths = [None, 0, 1, 99, 100, 101, 180, 181, 260, 1000]
    df = spark.createDataFrame([(i, None if n is None else "".join(chr(65 + j % 26) for j in range(n))) for i, n in enumerate(lengths)], "id int, t string")
    got = {}
    for r in windows.chunked(df, "t", 100, 20, mode).collect():
        got.setdefault(r.id, []).append((r.aa_start, r.aa_end, r.chunk))
    for i, n in enumerate(lengths):
        if not n:
            assert i not in got
            continue
        text = "".join(chr(65 + j % 26) for j in range(n))
        want, s = [], 0
        while True:
            e = min(s + 100, n)
            want.append((s, e))
            if e == n:
                break
            s = e - 20
        if mode == "grid" and n > 100:
            want[-1] = (n - 100, n)
        assert sorted(got[i]) == sorted((a, b, text[a:b]) for a, b in want)
    with pytest.raises(ValueError):
        windows.window_starts(F.lit(5), 10, 10, mode)


def test_greedy_batches(spark):
    sizes = [5, 5, 5, 30, 1, 1, 1, 1]
    df = spark.createDataFrame(list(enumerate(sizes)), "o int, n int").coalesce(1)
    rows = windows.greedy_batches(df, "n", "o", 20, 3).orderBy("o").collect()
    parts = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r.batch)]
    assert all(len(p) <= 3 and (sum(r.n + 2 for r in p) <= 20 or len(p) == 1) for p in parts)
    assert [r.o for r in rows] == list(range(8))


def test_peaks():
    v = np.array([0, 3, 1, 2, 2, 0, 5, 4, 4.5, 0])
    assert windows.peaks(v, 0.4, 1) == [(6, 5.0), (1, 3.0), (3, 1.0), (8, 0.5)]
    assert [p for p, _ in windows.peaks(v, 0.4, 3)] == [6, 1]
    assert windows.peaks(np.array([]), 0, 1) == windows.peaks(np.ones(5), 0, 1) == []


def test_monotone_totals(spark):
    rows = [("r", "p", 1, 5.0), ("r", "p", 2, 9.0), ("r", "q", 2, 1.0), ("r", "q", 4, 7.0)]
    got = [(r.t, r.total, r.peak) for r in windows.monotone_totals(spark.createDataFrame(rows, "run string, m string, t int, c double"), "run", "m", "t", "c").orderBy("t").collect()]
    assert got == [(1, 5.0, 5.0), (2, 10.0, 10.0), (4, 16.0, 16.0)]


def test_samples(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    a = [r.k for r in sampling.sample(df, ["k"], 20, 1).collect()]
    assert a == [r.k for r in sampling.sample(df.repartition(7), ["k"], 20, 1).collect()] and len(set(a)) == 20
    assert a != [r.k for r in sampling.sample(df, ["k"], 20, 2).collect()]
    n = sampling.ordinals(df, ["k"]).orderBy("n").collect()
    assert [r.n for r in n] == list(range(200)) and [r.k for r in n] == sorted(r.k for r in n)
    assert sampling.ordinals(df.limit(0), ["k"]).collect() == []
    x = spark.createDataFrame([(i, f"g{i % 30}" if i % 31 else None) for i in range(300)], "i int, g string")
    split = sampling.grouped_split(x, "g", 0.8, 0.1, 1).collect()
    assert len(split) == 300
    assert all(len({r.split for r in split if r.g == g}) == 1 for g in {r.g for r in split})


@pytest.mark.parametrize("mode", sampling.MODES)
def test_mutate(mode):
    seq = "ACDEFGHIKLMNPQRSTVWY" * 3
    out, changed = sampling.mutate(seq, np.arange(len(seq)), 0.3, mode, 5, "DE")
    again = sampling.mutate(seq, np.arange(len(seq)), 0.3, mode, 5, "DE")
    assert (out, changed) == again and len(out) == len(seq)
    assert not {seq[p] for p in changed} & set("DE")
    assert all(a == b for i, (a, b) in enumerate(zip(seq, out)) if i not in changed)
    if mode == "shuffle":
        assert sorted(out) == sorted(seq)
    else:
        assert all(out[p] != seq[p] for p in changed) and len(changed) == round(54 * 0.3)
    assert sampling.mutate("", np.arange(0), 0.5, mode, 1) == ("", [])


def test_nearest_and_graph(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for metric in ("cosine", "euclidean"):
        got = graph.nearest(df, "id", "v", df.filter("id < 30"), 4, metric).collect()
        for q in range(30):
            d = x.astype(np.float32).astype(float)
            s = np.maximum(0, u @ u[q]) if metric == "cosine" else 1 / (1 + np.linalg.norm(d - d[q], axis=1))
            want = [i for i in np.lexsort((np.arange(120), -np.round(s, 6))) if i != q][:4]
            assert [r.key for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == want
    whole = graph.nearest(df, "id", "v", df.filter("id < 30"), 4).collect()
    monkeypatch.setattr(graph, "QUERY_BLOCK", 7)  # several blocks
    assert sorted(graph.nearest(df, "id", "v", df.filter("id < 30"), 4).collect()) == sorted(whole)
    none = df.limit(0)
    assert graph.nearest(none, "id", "v", none, 3).collect() == []
    edges = spark.createDataFrame([(a, b, 1.0) for c in ((0, 1, 2, 3), (10, 11, 12)) for a, b in itertools.combinations(c, 2)], "src bigint, dst bigint, weight double")
    labels = {r.node: r.label for r in graph.communities(edges).collect()}
    assert len({labels[i] for i in (0, 1, 2, 3)}) == 1 and len({labels[i] for i in (10, 11, 12)}) == 1 and labels[0] != labels[10]
    freq = graph.bootstrap_consensus(edges, 6, 0.9, 0.0).collect()
    assert len(freq) == 9 and all(r.coassigned <= r.cosampled <= 6 for r in freq)
    assert graph.communities(edges.limit(0)).collect() == []


def test_components_keep_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * np.array([10, 5, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = graph.principal_components(df, "id", "v", 0.99).orderBy("id").collect()
    assert len(got[0].v) == 2
    c = x - x.mean(0)
    p = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert np.allclose(np.abs([r.v for r in got]), np.abs(p), atol=1e-6)


def test_statistics(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randrange(5)), rng.random()) for _ in range(60)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("d", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    f = pd.DataFrame(rows, columns=["k", "x", "y"])
    a = f[f.k == "a"]
    rho = {r.k: r.rho for r in stats.spearman(df, ["k"], "x", "y").collect()}
    assert rho["a"] == pytest.approx(a.x.rank().corr(a.y.rank())) and rho["c"] is None and rho["d"] is None
    s = {r.k: r for r in stats.dose_summary(df, ["k"], "y", F.col("y") > 0.5).collect()}
    assert s["a"].sem == pytest.approx(a.y.sem()) and s["d"].sem is None
    assert stats.random_hit(10, 3, 2) == pytest.approx(1 - math.comb(7, 2) / math.comb(10, 2)) and stats.random_hit(5, 5, 1) == 1.0
    x = np.arange(1, 30)
    fit = spark.createDataFrame([("k", float(i), float(50 * i / (7 + i))) for i in x], "k string, x double, y double")
    best = [r for r in stats.saturation_fits(fit, "k", "x", "y").collect() if r.best]
    assert best[0].model == "hyperbolic" and (best[0].a, best[0].b) == (pytest.approx(50, rel=1e-3), pytest.approx(7, rel=1e-2))


def test_model_is_independent_of_batches(spark):
    rows = [(i, "ACDEFGHIKL" * (1 + i % 5)) for i in range(12)] + [(100, ""), (101, None)]
    df = spark.createDataFrame(rows, "id int, s string")
    w = model.Weights.random(4, 1, (16, 12, 8))
    got = {r.id: r for r in model.score_chunks(df, "id", "s", model.hash_embedder(4), w, most_tokens=60).collect()}
    for i, s in rows[:12]:
        want = model.score_sequence(model.hash_embedder(4)([s])[0], w)
        assert got[i].P == pytest.approx(want["P"]) and got[i].w == pytest.approx(want["w"]) and got[i].error is None
        assert sum(got[i].w) == pytest.approx(1) and 0 <= got[i].S_idx <= got[i].E_idx < len(s)
    assert got[100].P is None and got[100].error and got[101].error


def test_resilient():
    calls, waits = [], []

    def embed(seqs):
        calls.append(list(seqs))
        if "bad" in seqs:
            raise RuntimeError("no")
        return [np.zeros((len(s), 2)) for s in seqs]

    out = model.resilient(embed, ["ab", "bad", "c"], 3, 1.0, waits.append)
    assert [e for _, e in out] == [None, "RuntimeError: no", None] and out[0][0].shape == (2, 2)
    assert waits == [1.0, 2.0, 1.0, 2.0] and len(calls) == 3 + 1 + 3 + 1


def test_chosen_span(spark):
    n = None
    rows = [(10, 100, n, n), (10, 20, 10, 200), (100, 10, 10, 200), (n, n, 10, 200), (n, n, 10, 15), (n, n, n, n), (n, n, 9, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [tuple(r[0]) for r in df.select(evidence.chosen_span(*(F.col(x) for x in "abcd"))).collect()]
    assert got == [("pp", 10, 100, "valid_pp"), ("", n, n, "pp_len_out_of_range:11"), ("ext", 10, 200, "fallback_ext_after_pp_wrapped:100>10"), ("ext", 10, 200, "fallback_ext_after_pp_missing"), ("", n, n, "ext_len_out_of_range:6"), ("", n, n, "pp_missing"), ("", n, n, "pp_missing")]
