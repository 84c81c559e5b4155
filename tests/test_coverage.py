import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators.coverage import IntervalMap, periods_and_gaps
from seqloom.streaming.interval_state import stream_periods

SCHEMA = "hit bigint, q string, a int, b int, s string, e string, kind string"


def brute(rows):
    out = set()
    by = {}
    for _, q, a, b, *_ in rows:
        if q is not None and a is not None and b is not None:
            by.setdefault(q.strip(" \t\r\n\f\v"), set()).update(range(min(a, b), max(a, b) + 1))
    for q, covered in by.items():
        last = None
        run = None
        for p in sorted(covered):
            if last is None or p > last + 1:
                if run is not None:
                    out.add((q, "period", run, last))
                    out.add((q, "gap", last + 1, p - 1))
                run = p
            last = p
        out.add((q, "period", run, last))
    return out


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 12)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_map_is_the_union(items):
    m, covered, n = IntervalMap(), set(), 0
    for start, size in items:
        n += m.insert(start, start + size)
        covered.update(range(start, start + size + 1))
    assert n == len(m.starts)
    assert {p for s, e in m.periods() for p in range(s, e + 1)} == covered
    assert all(s - e > 1 for e, s in zip(m.ends, m.starts[1:]))
    assert all(e >= s for s, e in m.gaps())


def rows_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = rng.choice(["hot", "hot", "hot ", "\thot", "b", "c", " c", None, ""])
        # over and along the borders of blocks
        base = rng.choice([1, 65_500, 65_536, 131_000, 200_000, -70_000])
        a = base + rng.randrange(300)
        b = a + rng.choice([0, 1, 5, 40, -30, 66_000 if rng.random() < 0.05 else 3])
        rows.append((i, q, None if rng.random() < 0.03 else a, None if rng.random() < 0.03 else b, "x", "y", "z"))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.q, r.kind, r.a, r.b) for r in periods_and_gaps(df, "q", "a", "b").collect()}
    assert got == brute(rows)


def test_touching_blocks_are_one_period(spark):
    df = spark.createDataFrame([("x", 65_530, 65_535), ("x", 65_536, 65_540), ("x", 0, 400_000), ("y", 1, 1)], "q string, a int, b int")
    got = sorted((r.q, r.kind, r.a, r.b) for r in periods_and_gaps(df, "q", "a", "b").collect())
    assert got == [("x", "period", 0, 400_000), ("y", "period", 1, 1)]


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), "q", "a", "b").collect() == []


def test_stream(spark, tmp_path):
    rows = rows_of(5, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(3):
        df.filter(f"hit % 3 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    out = []
    q = stream_periods(stream, "q", "a", "b").writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for n, key, _, kind, s, e in out:
        if last.get(key, (-1,))[0] < n:
            last[key] = (n, set())
        last[key][1].add((key, kind, s, e))
    assert set().union(*(x for _, x in last.values())) == brute(rows)


def by_ends(rows):
    """As brute, by sorting the ends, for intervals of any length."""
    by, out = {}, set()
    for _, q, a, b, *_ in rows:
        by.setdefault(q, []).append((min(a, b), max(a, b)))
    for q, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(q, "period", a, b) for a, b in merged}
        out |= {(q, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_very_long_intervals(spark, seed):
    """Intervals of many blocks, up to 2**50 positions, are not cut into all their blocks."""
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        a = rng.choice([0, 2**16, 2**20, 2**33, 2**40, -(2**34)]) + rng.choice([-1, 0, 1, rng.randrange(2**18), rng.randrange(2**36)])
        size = rng.choice([0, 3, 2**16 - 1, 2**16, 2**17, rng.randrange(2**19), 2**33] + [2**50] * (seed == 4))
        rows.append((i, rng.choice(["p", "q"]), a, a + size, "x", "y", "z"))
    got = periods_and_gaps(spark.createDataFrame(rows, "hit bigint, q string, a bigint, b bigint, s string, e string, kind string").repartition(3), "q", "a", "b")
    assert {tuple(r) for r in got.collect()} == by_ends(rows)
    assert got.count() == len(by_ends(rows))
