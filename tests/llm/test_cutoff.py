import math
import random

import pytest

from seqloom.llm.cutoff import cutoffs

SCORES = "score_id bigint, seq_id string, source string, metric string, value double, id string, k double, part int, rows bigint, total bigint"
TARGETS = "source string, metric string, fraction double, rows int, part string"


def brute(rows, targets):
    kept, report = set(), {}
    for source, metric, fraction, *_ in targets:
        low = metric == "evalue"
        best, ids = {}, set()
        for _, sid, src, _, v, *_ in rows:
            if src != source or sid is None:
                continue
            sid = sid.strip(" \t\r\n\f\v")
            ids.add(sid)
            if v is not None and math.isfinite(v):
                best[sid] = v if sid not in best else (min if low else max)(best[sid], v)
        at, keep = None, set()
        for t in sorted(set(best.values()), reverse=not low):
            now = {s for s, v in best.items() if (v <= t if low else v >= t)}
            if fraction is not None and len(now) / len(ids) <= fraction:
                at, keep = t, now
        kept |= {(source, s) for s in keep}
        report[source] = (at, len(keep), len(ids))
    return kept, report


def make(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["low", "flat", "one", None, "untargeted"])
        value = rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5.0, rng.random() * 10, float(round(rng.random() * 4))])
        if source == "flat":
            value = 1.0
        sid = rng.choice([None, "", f" s{rng.randrange(n // 2)}\t", f"s{rng.randrange(n // 2)}"])
        rows.append((i, sid, source, "x", value, "c", 1.0, 2, 3, 4))
    return rows + rows[:30]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.333, 1.0, None])
def test_like_brute_force(spark, seed, fraction):
    rows = make(seed, 300)
    targets = [("hot", "score", fraction, 1, "p"), ("low", "evalue", fraction, 1, "p"), ("flat", "score", fraction, 1, "p"), ("one", "score", fraction, 1, "p"), ("none", "score", 0.5, 1, "p")]
    kept, report = cutoffs(spark.createDataFrame(rows, SCORES).repartition(4), spark.createDataFrame(targets, TARGETS), partitions=5)
    want, numbers = brute(rows, targets)
    assert {(r.source, r.seq_id) for r in kept.collect()} == want
    assert {r.source: (r.threshold, r.kept, r.total) for r in report.collect()} == numbers


def test_fraction_is_compared_as_it_stands(spark):
    # 0.07 * 100 is a little more than 7 and 0.29 * 100 a little less than 29
    rows = [(i, f"s{i}", s, "x", float(i), "", 0.0, 0, 0, 0) for s in ("a", "b") for i in range(100)]
    targets = [("a", "score", 0.07, 0, ""), ("b", "score", 0.29, 0, "")]
    report = cutoffs(spark.createDataFrame(rows, SCORES), spark.createDataFrame(targets, TARGETS))[1]
    assert {r.source: r.kept for r in report.collect()} == {"a": 7, "b": 29}


def test_empty(spark):
    kept, report = cutoffs(spark.createDataFrame([], SCORES), spark.createDataFrame([("a", "score", 0.5, 1, "p")], TARGETS))
    assert kept.collect() == []
    assert [(r.threshold, r.kept, r.total, r.fraction) for r in report.collect()] == [(None, 0, 0, None)]
