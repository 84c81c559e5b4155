import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE()


@pytest.fixture(scope="module")
def theirs():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_PATH)
    t.encode_special_tokens = True
    return t


def ids_of(model, texts):
    ids, counts = model.encode(texts)
    out, at = [], 0
    for c in counts.tolist():
        out.append(ids[at : at + c].tolist())
        at += c
    return out


HARD = ["", " ", "\n\n \t", "<|endoftext|>", "a<|endoftext|>b", "don't DON'T we'll", "naïve café Größe ångström", "日本語のテキスト", "🙂🙃👩‍👩‍👧", "﻿x y​", "x" * 3000, "ACDEFGHIKLMNPQRSTVWY" * 900, " 1234567 3.14", "a\x00b", "…—“q”"]


def test_hard_texts(ours, theirs):
    assert ids_of(ours, HARD) == [e.ids for e in theirs.encode_batch(HARD, add_special_tokens=False)]


@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_like_the_library(ours, theirs, texts):
    assert ids_of(ours, texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_documents(ours, theirs, spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert ids_of(ours, [r.text for r in rows]) == [theirs.encode(r.text or "", add_special_tokens=False).ids for r in rows]


def test_rows(spark, ours):
    rows = [(1, "one two", "k", 1), (2, None, "k", 1), (3, "", "k", 1), (None, "x", "k", 1), (1, "one two", "k", 1), (5, "z" * 50_000, "k", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, ids int").repartition(2)
    got = bpe.encode_texts(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    want = sorted(((r[0], ids_of(ours, [r[1]])[0]) for r in rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=repr) == want
    counts = bpe.count_tokens(df, ["doc_id", "key"])
    assert sorted(((r.doc_id, r.tokens) for r in counts.collect()), key=repr) == sorted(((k, len(v)) for k, v in want), key=repr)


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_megabyte_in_one_piece(ours, theirs):
    """A word of very many letters takes seconds, not hours, and has the same ids."""
    rng = random.Random(3)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYacdtheing") for _ in range(1_000_000))
    began = time.perf_counter()
    assert ids_of(ours, [text, "é" * 4000, " " * 9000 + "x"]) == [e.ids for e in theirs.encode_batch([text, "é" * 4000, " " * 9000 + "x"], add_special_tokens=False)]
    assert time.perf_counter() - began < 60
