"""The whole chain from FASTA files, settings, archives, structure files, items, losses and augmentations."""

import io
import json
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import api
from seqloom.__main__ import main
from seqloom.functions import text as T
from seqloom.operators import augment, evidence, losses, model, sampling, stats, windows
from seqloom.settings import Options, resolved, weight_settings
from seqloom.sources import archives, fasta, items, sinks, tabular
from seqloom.streaming.progress import Progress


def small_embedder():
    return model.hash_embedder(4)


WEIGHTS = model.Weights.random(4, 1, (16, 12, 8))
SEQS = {"a|x": "MKVLAAGTRE" * 5, "b": "MDDGSSAAKL" * 3, "short": "MK", "odd": "M*-?" * 6}


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "one.fasta").write_text("".join(f">{k} some words\n{v}\n" for k, v in SEQS.items()) + ">empty\n\n>b again\nMKKKKKKKKKKKK\n")
    return str(tmp_path / "one.fasta")


def test_chain(spark, files, tmp_path):
    options = Options(chunk_len=20, chunk_overlap=4, least_p=0.0)
    got = api.fasta_to_features(spark, files, small_embedder(), WEIGHTS, str(tmp_path / "g"), str(tmp_path / "w"), str(tmp_path / "l"), options).collect()
    assert [r.base_id for r in got] == ["a|x", "b", "odd", "short"]
    features = tabular.read_gff3(spark, str(tmp_path / "g"), "RdRP_domain").collect()
    assert {r.seqid for r in features} == {r.base_id for r in got}
    for r in got:
        assert 1 <= r.start <= r.end <= r.orig_len and r.is_best_base_chunk
        f = next(f for f in features if f.seqid == r.base_id)
        assert (f.start, f.end, f.attrs["Chunk"]) == (r.start, r.end, r.chunk_id) and f.attrs["P"] == f"{r.P:.6f}"
    logits = spark.read.json(str(tmp_path / "l" / "*.json")).collect()
    assert sum(r.is_best_base_chunk for r in logits) == 4 and len(logits) > 4
    assert spark.read.json(str(tmp_path / "w" / "*.json")).filter("size(w) <> L or size(abs_pos) <> L").count() == 0
    # the last of repeated ids counts, and strict leaves out what is short or mostly changed
    strict = {r.seq_id: r.seq for r in api.sanitised_records(spark, files, Options(strict=True)).collect()}
    assert set(strict) == {"a|x", "b"} and strict["b"] == "MKKKKKKKKKKKK"


def test_command_line(spark, files, tmp_path, monkeypatch, capsys):
    WEIGHTS.save(str(tmp_path / "w.npz"))
    (tmp_path / "side.json").write_text(json.dumps({"k_sigma": 1.5, "tau": 9}))
    monkeypatch.setattr("seqloom.__main__.local_session", lambda cpus: spark)
    assert main([files, "--weights", str(tmp_path / "w.npz"), "--embedder", f"{__name__}:small_embedder", "--sidecar", str(tmp_path / "side.json"), "--gff", str(tmp_path / "out"), "--least-p", "0", "--chunk-len", "30", "--chunk-overlap", "5"]) == 0
    assert "4 features" in capsys.readouterr().out
    assert tabular.read_gff3(spark, str(tmp_path / "out")).count() == 4


def test_settings():
    got = resolved({"tau": 2, "k_sigma": 3, "d": 1}, {"tau": 5, "k_sigma": 1, "x": 7}, {"d": None, "least_p": 0.1})
    assert got == {"tau": 2, "k_sigma": 1, "d": 1, "x": 7, "least_p": 0.1}
    assert weight_settings(got) == {"tau": 2, "k_sigma": 1}
    assert Options.of(got) == Options(least_p=0.1)


def test_batched_tokens():
    rng = np.random.default_rng(1)
    tokens = [rng.normal(size=(n, 4)) for n in (1, 7, 30)]
    for one, many in zip([model.score_sequence(t, WEIGHTS) for t in tokens], model.score_batch(tokens, WEIGHTS)):
        assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
    assert model.score_batch([], WEIGHTS) == []


def test_strict_reading(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text("\nMKV\n>a\nMK\n")
    (tmp_path / "good.fasta").write_text("\n \n>a\nMK\n>b\nM*k \n")
    with pytest.raises(ValueError, match="before a header"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fasta"), strict=True)
    got = fasta.read_fasta(spark, str(tmp_path / "good.fasta"), strict=True, clean="printable").collect()
    assert [(r.seq_id, r.seq) for r in got] == [("a", "MK"), ("b", "MK")]
    assert [r.seq_id for r in fasta.fetch(fasta.read_fasta(spark, str(tmp_path / "good.fasta")), spark.createDataFrame([("b",), (None,)], "id string")).collect()] == ["b"]
    with pytest.raises(Exception, match="not a chunk id"):
        spark.createDataFrame([("zz",)], "c string").select(T.required_chunk(F.col("c"))).collect()


def test_archives(spark, tmp_path):
    report = {"meta": {"n": 5}, "result": {"seconds": 1.5}, "samples": [{"t_rel_s": 0.5, "process": {"rss_bytes": 10, "cpu_percent": 2.0}}, {"t_rel_s": 1.0, "process": None}]}
    with tarfile.open(tmp_path / "runs.tar.gz", "w:gz") as tar:
        for name, text in (("d/r1.json", json.dumps(report)), ("d/bad.json", "{"), ("d/readme.txt", "x")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    runs, samples = archives.read_run_archives(spark, str(tmp_path / "runs.tar.gz"))
    assert {tuple(r) for r in runs.collect()} == {("r1", 5, 1.5), ("bad", None, None)}
    assert sorted(map(tuple, samples.collect())) == [("r1", 0.5, 10, 2.0), ("r1", 1.0, None, None)]


STRUCTURE = """data_X
# a comment
_entity.id 1
_entity.name 'a b'
loop_
_atom_site.id
_atom_site.label_entity_id
_atom_site.auth_asym_id
_atom_site.note
1 1 A "it's"
2 1 'B' .
3 2 C
;two
lines
;
loop_
_other.a
_other.b
x ?
"""


def test_structures(spark, tmp_path):
    (tmp_path / "m.cif").write_text(STRUCTURE)
    rows = archives.category(STRUCTURE, "_atom_site")
    assert [(r["auth_asym_id"], r["note"]) for r in rows] == [("A", "it's"), ("B", None), ("C", "two\nlines")]
    assert archives.category(STRUCTURE, "_entity") == [{"id": "1", "name": "a b"}] and archives.category(STRUCTURE, "_other") == [{"a": "x", "b": None}] and archives.category("", "_x") == []
    got = archives.read_structures(spark, str(tmp_path / "m.cif"), fields=["label_entity_id", "auth_asym_id", "missing"]).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "1", "A", None), (1, "1", "B", None), (2, "2", "C", None)]


def test_items(spark, tmp_path):
    assert items.label_map(None) == items.label_map("x") == items.label_map("[1]") == items.LABELS
    assert items.label_map('{"0": "a", "b": 1, "c": "d"}') == {0: "a", 1: "b"}
    v = lambda *x: spark.createDataFrame(list(x), "id string, v array<double>")
    with pytest.raises(ValueError, match="several widths"):
        items.vector_sets([v(("a", [1.0])), v(("b", [1.0, 2.0]))])
    df = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), ("j", 4)], "k string, n int")
    assert sorted((r.n, r.item) for r in items.unique_keys(df, "k", ["n"]).collect()) == [(1, "k"), (2, "k__1"), (3, None), (4, "j")]
    none = spark.createDataFrame([], "chunk_id string, emb array<array<float>>")
    items.write_items(none, str(tmp_path / "i"))
    sinks.write_gff3(spark.createDataFrame([], "base_id string, start int, end int, P double"), str(tmp_path / "g"))
    assert "".join(p.read_text() for p in (tmp_path / "g").glob("*.txt")) == "##gff-version 3\n"


def test_losses(spark):
    rows = [(2, 1.5), (2, -0.5), (1, 0.3), (1, -3.0), (0, 2.0), (None, 9.0)]
    z = lambda y: [a for b, a in rows if b == y]
    bce = lambda xs, t: sum(math.log1p(math.exp(-x if t else x)) for x in xs) / len(xs)
    df = spark.createDataFrame(rows, "y int, z double")
    got = df.select(losses.nonnegative_pu(F.col("z"), F.col("y"), 0.3).alias("pu"), losses.clean_negative(F.col("z"), F.col("y"), 2.0).alias("n")).first()
    assert got.pu == pytest.approx(0.3 * bce(z(2), 1) + max(0.0, bce(z(1), 0) - 0.3 * bce(z(2), 0))) and got.n == pytest.approx(2 * bce(z(0), 0))
    assert df.filter("false").select(losses.nonnegative_pu(F.col("z"), F.col("y"), 0.3).alias("pu")).first().pu == 0
    kl = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75], True), ([1.0, 0.0], [0.5, 0.5], False)], "t array<double>, a array<double>, u boolean")
    assert kl.select(losses.alignment_loss(F.col("a"), F.col("t"), F.col("u"))).first()[0] == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    with pytest.raises(ValueError):
        losses.nonnegative_pu(F.col("z"), F.col("y"), 1.0)


def test_augmentations(spark):
    df = spark.range(400).select("id", (F.col("id") % 37 + 1).cast("int").alias("n"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = df.select("id", "n", augment.random_crop(F.col("n"), 10, 1, F.col("id")).alias("c"), augment.kept_tokens(F.col("n"), 0.5, 1, F.col("id"), F.lit(0), 1).alias("k"), augment.with_noise(F.col("v"), 0.5, 1, F.col("id")).alias("x")).collect()
    for r in got:
        assert r.c.end - r.c.start == min(10, r.n) and 0 <= r.c.start and r.c.end <= r.n
        assert len(r.k) == r.n and all(r.k[:2])
    noise = np.array([np.array(r.x) - [1, 2] for r in got])
    assert abs(noise.mean()) < 0.06 and abs(noise.std() - 0.5) < 0.05
    assert 0.3 < np.mean([np.mean(r.k[2:]) for r in got if r.n > 10]) < 0.7


def test_decisions(spark):
    def code(hit, clash, score, strong, source, span_clash, full):
        lit = lambda v: F.lit(v)
        return spark.range(1).select(evidence.decision(lit(hit), lit(clash), lit(score).cast("double"), lit(strong), lit(source).cast("string"), lit(span_clash), lit(full))).first()[0]

    cases = [(True, True, 80.0, True, "pp", False, True), (True, False, 80.0, True, "pp", False, False), (True, None, 80.0, True, "ext", None, None), (False, False, None, False, "", False, True), (True, False, 80.0, True, "ext", True, False), (True, False, 80.0, True, "", False, False), (True, True, 1.0, False, "pp", False, False), (True, False, 1.0, False, "pp", False, True), (True, False, None, None, None, None, None), (False, True, 80.0, True, "pp", False, False), (False, False, 3.0, False, "pp", False, False), (None, None, None, None, None, None, None)]
    assert tuple(code(*c) for c in cases) == evidence.DECISIONS


def test_windows_and_samples(spark):
    df = spark.createDataFrame([("a", 25), ("b", 10), ("c", 3), ("d", 0), ("e", None)], "k string, n int")
    got = sorted((r.k, r.w_start, r.w_end) for r in windows.scan_windows(df, "n", 10, 10).collect())
    assert got == [("a", 0, 10), ("a", 10, 20), ("a", 15, 25), ("b", 0, 10), ("c", 0, 3)]
    assert [r.w_start for r in windows.scan_windows(df.filter("k = 'a'"), "n", 10, 10, tail=False).collect()] == [0, 10]
    drawn = sampling.bootstrap(spark.range(50).select(F.col("id").alias("k")), "k", 0.3, 3, 1).collect()
    assert [sum(r.iteration == b for r in drawn) for b in range(3)] == [15] * 3 and len({(r.iteration, r.k) for r in drawn}) == 45
    assert sampling.bootstrap(spark.range(1).select(F.col("id").alias("k")), "k", 0.3, 2, 1).count() == 2


def test_silhouette(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(8, 3)), rng.normal(size=(9, 3)) + 4, [[9.0, 0, 0]]))
    c = [0] * 8 + [1] * 9 + [2]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        mean = lambda k: np.mean([d[i, j] for j in range(len(x)) if c[j] == k and j != i])
        a, b = (mean(c[i]), min(mean(k) for k in {0, 1, 2} - {c[i]})) if c.count(c[i]) > 1 else (0, 0)
        want.append((b - a) / max(a, b) if c.count(c[i]) > 1 else 0.0)
    df = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, c)], "v array<double>, c int")
    assert stats.silhouette(df, "v", "c").first().silhouette == pytest.approx(np.mean(want))
    assert stats.silhouette(df.filter("c = 0"), "v", "c").first().silhouette is None


def test_progress():
    now = iter([0.0, 2.0, 4.0])
    p = Progress(expected=100, clock=lambda: next(now))
    assert p.add(20) == "20 rows in 1 batches, 10.0 rows/s, 8 s left"
    assert p.add(20).startswith("40 rows in 2 batches, 10.0")
