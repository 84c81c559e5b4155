import random

import pytest

from seqloom.llm.components import components
from seqloom.llm.groupsplit import groups, splits

LABELS = "row_id bigint, ids string, labels int, isolate string, node bigint, protein string, u int"
MANIFEST = "chunk_id string, orig_id string, row_id bigint, ids string"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    # a long chain, a star and random links
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5, i) for i in range(6, 200)] + [(rng.randrange(300, 700), rng.randrange(300, 700)) for _ in range(150)]
    rng.shuffle(edges)
    rows = [*edges, (7, 7), (None, 3), (3, None), *edges[:20]]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    want = union(edges, {x for e in edges for x in e})
    assert got == {n: r for n, r in want.items() if n != r}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def make(seed, n=300):
    rng = random.Random(seed)
    manifest, rows = [], []
    for i in range(n):
        base = f"p{rng.randrange(80)}"
        style = rng.choice(["{}|chunk_0001_of_0002|aa_0_9", "{}_chunk_1_of_2", "{}", " {}|chunk_9_of_9\t"])
        ids = rng.choice([style.format(base)] * 20 + [None, ""])
        rows.append((i + 1, ids, rng.choice([0, 1, 2, None]), rng.choice([None] * 12 + ["", f"iso{rng.randrange(20)}"]), 1, "x", 2))
        if rng.random() < 0.5 and ids:
            manifest.append((ids.strip(), rng.choice([None, f"orig{rng.randrange(60)}", base]), i, "x"))
    return rows + rows[:9], manifest


def brute(rows, manifest):
    known = {}
    for c, o, *_ in manifest:
        if o is not None:
            known[c] = min(o, known.get(c, o))
    by, pairs = {}, []
    for rid, ids, _, iso, *_ in rows:
        if ids is not None:
            ids = ids.strip(" \t\r\n\f\v")
            cut = [p for p in (ids.find("|chunk_"), ids.find("_chunk_")) if p >= 0]
            protein = known.get(ids, ids[: min(cut)] if cut else ids)
            pairs.append((by.setdefault(("p", protein), rid), rid))
        if iso:
            pairs.append((by.setdefault(("i", iso), rid), rid))
    return union(pairs, {r[0] for r in rows})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups(spark, seed):
    rows, manifest = make(seed)
    got = groups(spark.createDataFrame(rows, LABELS).repartition(3), spark.createDataFrame(manifest, MANIFEST))
    assert {r.row_id: r.group_id for r in got.collect()} == brute(rows, manifest)


def test_splits(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(1500):
        for _ in range(rng.choice([1] * 9 + [6]) if g else 700):  # one group holds a fifth of all rows
            n += 1
            rows.append((n, g, rng.choice([0, 0, 1, 2, None])))
    df = spark.createDataFrame(rows, "row_id bigint, group_id bigint, label int")
    got = splits(df, partitions=4)
    a = {r.row_id: r.split for r in got.collect()}
    assert len(a) == n
    of = {}
    for rid, g, _ in rows:
        of.setdefault(g, set()).add(a[rid])
    assert all(len(s) == 1 for s in of.values())
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(s == name for s in a.values()) - share * n) <= 4
        for label in (0, 1, 2, None):
            every = [rid for rid, _, x in rows if x == label]
            assert abs(sum(a[r] == name for r in every) - share * len(every)) <= 0.1 * len(every) * share + 8
    assert {r.row_id: r.split for r in splits(df, partitions=4).collect()} == a  # the same again


def test_empty(spark):
    g = groups(spark.createDataFrame([], LABELS), spark.createDataFrame([], MANIFEST))
    assert g.collect() == []
    assert splits(g).collect() == []


def test_many_equal_components():
    """The steps grow with the components, so that a partition is evened out whatever their number."""
    import numpy as np

    from seqloom.llm.groupsplit import _anneal, _hashed

    n, share = 30_000, np.array([0.8, 0.1, 0.1])
    sizes = np.tile([1.0, 1.0, 0, 0, 0], (n, 1))
    start = np.stack([_hashed(np.arange(n), s, share).astype(np.int8) for s in (1, 2)])
    where = _anneal(sizes, start, np.stack([share[:, None] * sizes.sum(0)[None, :]] * 2), [1, 2], 2 * n)
    for w in where:
        assert np.abs(np.bincount(w, minlength=3) - share * n).max() <= 2
