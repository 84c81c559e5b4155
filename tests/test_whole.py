"""Queries over whole tables against brute force that leaves no row out."""

import duckdb
import numpy as np
import pytest

from seqloom.plans import vectors


@pytest.fixture(scope="module")
def directed(data):
    """{(query, key): similarity}: every vector's five most similar of all."""
    got = duckdb.sql(f"select vec_id, embedding from '{data}/embeddings.parquet' order by vec_id").fetchall()
    ids = [r[0] for r in got]
    x = np.array([r[1] for r in got], np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(np.maximum(0.0, x @ x.T), 6)
    np.fill_diagonal(s, -1)
    return {(ids[i], ids[j]): s[i, j] for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:5]}


def test_undirected_edges_of_all_vectors(spark, data, directed):
    want = {}
    for (a, b), s in directed.items():
        want[min(a, b), max(a, b)] = max(s, want.get((min(a, b), max(a, b)), 0.0))
    got = {(r.src, r.dst): r.weight for r in vectors.g1_undirected(spark, data).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_mutual_edges_of_all_vectors(spark, data, directed):
    got = {(r.src, r.dst) for r in vectors.g2_mutual(spark, data).collect()}
    assert got == {(a, b) for a, b in directed if a < b and (b, a) in directed}


def test_adjacency_of_all_vectors(spark, data, directed):
    want = {}
    for a, b in directed:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    assert {r.node: set(r.neighbours) for r in vectors.g3_adjacency(spark, data).collect()} == want


def test_communities_of_all_vectors(spark, data, directed):
    every = {a for a, _ in directed}
    assert {r.node for r in vectors.g5_communities(spark, data).collect()} == every
    pairs = {(min(k), max(k)) for k in directed}
    consensus = {(r.src, r.dst) for r in vectors.g6_consensus(spark, data).collect()}
    assert consensus <= pairs and any(a % 20 or b % 20 for a, b in consensus)
    assert {r.node for r in vectors.g8_consensus_clusters(spark, data).collect()} == {n for p in consensus for n in p}


def test_lanes_of_all_hits(spark, data):
    from seqloom.plans import spans

    sql = f"""select hit_id, trim(qid, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), greatest(0, least(ali_from, ali_to) - 1), greatest(0, ali_from, ali_to) - 1
      from '{data}/hmmer_dom_hits.parquet' where qid is not null and ali_from is not null and ali_to is not null order by hit_id"""
    lanes, want = {}, {}
    for hit, qid, s, e in duckdb.sql(sql).fetchall():
        ends = lanes.setdefault(qid, [])
        lane = next((i for i, x in enumerate(ends) if x < s), len(ends))
        ends[lane : lane + 1] = [e]
        want[hit] = (qid, s, e, lane)
    assert {r.hit_id: (r.qid, r.s, r.e, r.lane) for r in spans.i8_pack_lanes(spark, data).collect()} == want


def test_first_free_lane():
    from seqloom.operators.intervals import _Lanes

    rng = np.random.default_rng(1)
    free, ends = _Lanes(), []
    for _ in range(3000):
        s = int(rng.integers(0, 900))
        e = s + int(rng.integers(0, 300))
        lane = next((i for i, x in enumerate(ends) if x < s), len(ends))
        ends[lane : lane + 1] = [e]
        assert free.take(s, e) == lane


def test_positions_of_the_whole_length(spark, data):
    want = {(i, t): n for i, t, n in duckdb.sql(f"select entry_id, exported_at, L from '{data}/pooled_json.parquet'").fetchall()}
    got = {(r.entry_id, r.exported_at): r.p for r in vectors.f19_positions(spark, data).collect()}
    assert {i for i, _ in got} == {i for i, _ in want} and max(want.values()) > 20
    assert sorted(map(len, got.values())) == sorted(want.values())
    assert all(p == pytest.approx([i / max(1, len(p) - 1) for i in range(len(p))], abs=1e-6) for p in got.values())
