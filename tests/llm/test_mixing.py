import random

import pytest

from seqloom.llm.mixing import language, mix, plan


def test_plan_redistributes_to_siblings_first():
    leaves = [(("d", "a", "en"), 100.0, 1), (("d", "a", "de"), 100.0, 1), (("d", "b", "en"), 10.0, 2), (("e", "c", "en"), 1000.0, 1)]
    got = plan(leaves, {"a": 1.0, "b": 1.0, "c": 2.0}, 1, 400.0)
    # b can give 20 of its 100; a, its sibling in the same domain, takes the rest
    assert got == pytest.approx({("d", "a", "en"): 90.0, ("d", "a", "de"): 90.0, ("d", "b", "en"): 20.0, ("e", "c", "en"): 200.0})
    # beyond what the domain holds, the other domain takes over
    got = plan(leaves, {"a": 1.0, "b": 1.0, "c": 2.0}, 1, 600.0)
    assert got == pytest.approx({("d", "a", "en"): 100.0, ("d", "a", "de"): 100.0, ("d", "b", "en"): 20.0, ("e", "c", "en"): 380.0})


def test_plan_never_exceeds_capacity():
    rng = random.Random(1)
    for _ in range(200):
        leaves = [((rng.choice("xy"), f"s{i % 5}", rng.choice(["en", "de", "es"]) + str(i)), float(rng.randrange(1, 500)), [1, 2, 0, 3, 1][i % 5]) for i in range(12)]
        weights = {f"s{i}": rng.choice([0.0, 1.0, 2.5]) for i in range(5)}
        total = rng.choice([10.0, 500.0, 1e6])
        got = plan(leaves, weights, 1, total)
        room = {p: t * r for p, t, r in leaves}
        assert all(-1e-6 <= b <= room[p] * (1 + 1e-6) for p, b in got.items())
        assert sum(got.values()) == pytest.approx(min(total, sum(room.values())), rel=1e-6)


DOCS = "doc_id bigint, source string, lang string, tokens bigint, weight double, epochs int, rest double"


def test_mixture(spark):
    rng = random.Random(2)
    rows = []
    for source, n in (("big", 6000), ("mid", 900), ("tiny", 8), ("unlisted", 50), (None, 10)):
        rows += [(len(rows) + i, source, rng.choice(["en", "de", None]), rng.choice([0, 20, 50, 120]), 1.0, 2, 3.0) for i in range(n)]
    rng.shuffle(rows)
    targets = [("big", 5.0, 1), ("mid", 3.0, 4), ("tiny", 2.0, 3), ("absent", 1.0, 2), ("off", None, 5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    goals = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    uses, report = mix(docs, goals, total=120_000.0)
    repeats = {s: m for s, _, m in targets}
    tokens = {r[0]: (r[1], r[3]) for r in rows}
    seen = set()
    for r in uses.collect():
        assert r.doc_id not in seen
        seen.add(r.doc_id)
        assert 1 <= r.uses <= repeats[r.source]
        assert tokens[r.doc_id] == (r.source, r.tokens) and r.tokens > 0
    by = {r.source: r for r in report.collect()}
    assert set(by) == set(repeats)
    assert by["absent"].tokens == 0 and by["absent"].short and by["tiny"].short and not by["big"].short
    assert by["tiny"].tokens == 3 * by["tiny"].available
    total = sum(r.tokens for r in by.values())
    assert abs(total - 120_000) <= 400
    assert by["big"].tokens / by["mid"].tokens == pytest.approx(5 / 3, rel=0.02)
    assert sum(r.share for r in by.values()) == pytest.approx(1)
    again = mix(docs.repartition(2), goals, total=120_000.0)[0]
    assert {(r.doc_id, r.uses) for r in again.collect()} == {(r.doc_id, r.uses) for r in uses.collect()}
    # every document of a source is used equally often, but for one
    for s in ("big", "mid"):
        times = {r.uses for r in uses.filter(f"source = '{s}'").collect()}
        assert len(times) <= 2


def test_empty(spark):
    uses, report = mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int"))
    assert uses.collect() == []
    assert [(r.source, r.tokens, r.share) for r in report.collect()] == [("a", 0, 0.0)]


def test_language(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("en",), (" EN ",), ("de-DE",), ("es_MX",), (None,), ("",), ("english text",)], "lang string")
    assert [r[0] for r in df.select(language(F.col("lang"))).collect()] == ["en", "en", "de", "es", "und", "und", "und"]


def test_remainders_go_to_documents_that_fit(spark):
    """A document that is too large for what is left doesn't end the selection."""
    rows = [(i, "a", "en" if i % 2 else "de", 5000 if i % 10 == 0 else 40, 1.0, 1, 1.0) for i in range(200)]
    rows += [(1000 + i, "b", "en", 50, 1.0, 1, 1.0) for i in range(400)]
    goals = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    for total in (6000.0, 15_000.0, 23_456.0):
        _, report = mix(spark.createDataFrame(rows, DOCS).repartition(3), goals, total=total)
        for r in report.collect():
            assert r.budget == pytest.approx(total / 2) and abs(r.tokens - total / 2) <= 25
