import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.operators import joins
from seqloom.operators.joins import cascade_match, contains_join, finder, mentions, pattern_bits
from seqloom.plans.tables import SQL, pred11_mentions


def test_contains(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab|") for _ in range(n))
    texts = [word(rng.randrange(0, 12)) for _ in range(40)] + [None, ""]
    patterns = [word(rng.randrange(1, 4)) for _ in range(15)] + [None, ""]
    got = contains_join(spark.createDataFrame([(t, 1) for t in texts], "t string, n int"), "t", spark.createDataFrame([(p, 2) for p in patterns], "p string, n int"), "p")
    assert {(r.t, r.p) for r in got.collect()} == {(t, p) for t in texts for p in patterns if t and p and p in t}
    assert contains_join(spark.createDataFrame([("a",)], "t string"), "t", spark.createDataFrame([], "p string"), "p").collect() == []


def test_mentions_are_the_pairs_of_rows(spark):
    texts = ["aaaa", "aaaa", "Größe β-Faltblatt 🧬🧬", "xREF1REF12", "", None, "\0a\0"]
    patterns = ["a", "a", "aa", "ß", "β-", "🧬", "REF1", "REF12", "REF123", "\0", "", None]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = mentions(left, "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p", ["id"])
    want = Counter((i, p) for i, t in enumerate(texts) for p in patterns if t is not None and p is not None and p in t)
    assert Counter((r.id, r.p) for r in got.collect()) == want


@pytest.mark.parametrize("held", [64, 1 << 24])
def test_windows_across_blocks_and_rows(held, monkeypatch):
    monkeypatch.setattr(joins, "HELD", held)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abä") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    patterns = ["".join(rng.choice("abä") for _ in range(n)) for n in (1, 2, 3, 4, 9, 30)] + [texts[3][5:], texts[4]]
    patterns = [p for p in patterns if p]
    slots = pattern_bits(pa.array([p.encode() for p in patterns]), 16)
    lengths = {len(p.encode()) for p in patterns}
    for block in (1, 7, 64, 1 << 16):
        found = finder(lengths, slots, block)(pa.array([None, *(t.encode() for t in texts)])[1:])
        rows = list(zip(found["row"].to_pylist(), found["c"].to_pylist()))
        assert len(rows) == len(set(rows))
        assert {(r, c) for r, c in rows if c in {p.encode() for p in patterns}} == {(i, p.encode()) for i, t in enumerate(texts) for p in patterns if p in t}


def test_windows_only_across_rows():
    assert finder([2], pattern_bits(pa.array([b"bc"]), 16))(pa.array([b"ab", b"", b"cd"])).num_rows == 0


def test_long_texts_take_time_in_proportion():
    text = np.random.default_rng(3).integers(97, 123, 8_000_000, np.uint8).tobytes()
    pattern = text[-9:]
    began = time.thread_time()
    found = finder([9], pattern_bits(pa.array([pattern]), 16))(pa.array([text]))
    assert time.thread_time() - began < 20  # a row for each place, with the text, would be 64 TB
    assert pattern in found["c"].to_pylist()
    assert len(found) < 1000


def test_pred11_on_repeated_accessions_and_a_very_long_text(spark, duck, tmp_path):
    texts = ["REF1 and REF1", "REF1 and REF1", None, "", "REF2x", "ref1", "r" * 300_000 + "REF2"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("REF1",), ("REF1",), ("REF2",), ("REF3",), (None,)], "acc string").write.parquet(f"{tmp_path}/reference_panel.parquet")
    found = pred11_mentions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for each place of a text, which holds the text
    con = duck.cursor()
    for name in ("documents", "reference_panel"):
        con.execute(f"create temp view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(SQL["pred11_mentions"]).fetchall()) == [("REF1", 4), ("REF2", 2)]


def test_cascade(spark):
    left = spark.createDataFrame([("x1",), ("x1",), ("ab",), ("longer_zz",), ("q",), (None,), ("",)], "a string")
    right = spark.createDataFrame([("x1",), ("x12",), ("cab",), ("zz",), ("q1",), ("q2",), (None,)], "b string")
    got = {r.a: (r.b, r.how) for r in cascade_match(left, "a", right, "b").collect()}
    assert got == {"x1": ("x1", "exact"), "ab": ("cab", "contained"), "longer_zz": ("zz", "contained"), "q": (None, "ambiguous"), "": (None, "none")}
