"""Readers and writers on small files with the usual faults."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.sources import fasta, sinks, tabular
from seqloom.streaming import pipeline

FASTA = ">s1 first protein\r\nACD\r\nEFG \r\n\r\n>\nAAA\n>empty one\n>s1\n  MK*\nL-X\n\n> spaced id\nCC\n"
WANT = [("s1", "s1 first protein", "ACDEFG"), ("unnamed", "", "AAA"), ("empty", "empty one", ""), ("s1", "s1", "MK*L-X"), ("spaced", "spaced id", "CC")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.fasta").write_bytes(("\n\n" + FASTA).encode())
    with gzip.open(tmp_path / "b.fasta.gz", "wb") as f:
        f.write(b">z\nGG\n")
    return tmp_path


def test_fasta(spark, folder):
    rows = fasta.read_fasta(spark, str(folder / "a.fasta"), numbered=True).orderBy("ord").collect()
    assert [(r.seq_id, r.header, r.seq) for r in rows] == WANT
    assert [r.ord for r in rows] == list(range(5))
    both = fasta.read_fasta(spark, [str(folder / "a.fasta"), str(folder / "b.fasta.gz")], empty="drop")
    assert sorted(r.seq for r in both.collect()) == sorted([s for *_, s in WANT if s] + ["GG"])
    assert fasta.count_records(spark, str(folder / "a.fasta")) == 5
    assert sorted(r.length for r in fasta.lengths(spark, str(folder / "a.fasta")).collect()) == [0, 2, 3, 6, 6]
    (folder / "none.fasta").write_text("\n")
    with pytest.raises(ValueError):
        fasta.lengths(spark, str(folder / "none.fasta"))


def test_fasta_is_split(spark, tmp_path):
    records = [(f"r{i}", "ACDEFGHIKL" * (1 + i % 40)) for i in range(3000)]
    (tmp_path / "big.fasta").write_text("".join(f">{i} x\n{s[:60]}\n{s[60:]}\n" for i, s in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = fasta.read_fasta(spark, str(tmp_path / "big.fasta"), numbered=True)
        rows = df.orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.seq_id, r.seq) for r in rows] == records


@pytest.mark.parametrize("width", [0, 7, 60])
def test_fasta_round_trip(spark, tmp_path, width):
    df = spark.createDataFrame([("a", "ACD" * 50), ("b", "A" * 7), ("c", "A" * 14), ("d", "")], "seq_id string, seq string")
    sinks.write_fasta(df, str(tmp_path / "out"), width=width)
    back = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.seq_id, r.seq) for r in back.collect()) == sorted((r.seq_id, r.seq) for r in df.collect())
    lines = [line for p in (tmp_path / "out").glob("*.txt") for line in p.read_text().splitlines()]
    assert all(len(line) <= (width or 150) or line[0] == ">" for line in lines)


def test_gff3(spark, tmp_path):
    df = spark.createDataFrame([("toy", 3, 9, 0.9, 1), ("low", 1, 2, 0.1, 2), ("nop", 1, 2, None, 3)], "base_id string, start int, end int, P double, k int")
    sinks.write_gff3(df, str(tmp_path / "g"), least_p=0.5, extra=["k"])
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("*.txt"))
    assert text == "##gff-version 3\ntoy\tseqloom\tRdRP_domain\t3\t9\t0.900000\t.\t.\tID=toy;P=0.900000;k=1\n"
    (tmp_path / "x.gff").write_text(text + "short\tline\n\nq\tp\tother\t9\t2\t.\t+\t.\tID=q;x\n")
    rows = tabular.read_gff3(spark, str(tmp_path / "x.gff")).orderBy("seqid").collect()
    assert [(r.seqid, r.start, r.end, r.score, r.attrs) for r in rows] == [("q", 2, 9, None, {"ID": "q"}), ("toy", 3, 9, 0.9, {"ID": "toy", "P": "0.900000", "k": "1"})]
    assert tabular.read_gff3(spark, str(tmp_path / "x.gff"), "other").count() == 1


def write(tmp_path, text):
    (tmp_path / "f.tsv").write_text(text)
    return str(tmp_path / "f.tsv")


def test_catch(spark, tmp_path):
    head = "Sequence_name\tseq_len\tevalue\tbitscore\tfrom\tto\tseq_cov\tprofile_cov\n"
    path = write(tmp_path, head + "a\t100\t1e-5\t50\t1\t90\t0.9\t0.5\n" + head + "a\t100\t1e-9\t40\t2\t80\t0.8\t-\nb\tx\t-\t7\t1.0\t3.9\t\t\n\t1\t1\t1\t1\t1\t1\t1\n")
    rows = {r.qid: r for r in tabular.read_catch(spark, path).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].evalue == 1e-9 and rows["a"].profile_cov is None
    assert (rows["b"].seq_len, rows["b"].evalue, rows["b"].start, rows["b"].end) == (None, None, 1, 3)
    with pytest.raises(ValueError, match="missing"):
        tabular.read_catch(spark, write(tmp_path, "Sequence_name\tevalue\n"))


def test_annotations(spark, tmp_path):
    path = write(tmp_path, "a\trdrp=80\tpp_lo=5\tpp_hi=90\tseqA=X\na\trdrp=80\tpp_lo=9\tpp_hi=2\tseqA=X\tseqB=Y\nb\tjunk\n")
    rows = {r.qid: r for r in tabular.read_annotations(spark, path).collect()}
    assert (rows["a"].score, rows["a"].pp_lo, rows["a"].motifs) == (80.0, 5, 1)
    assert rows["b"].score is None and rows["b"].kv == {}


def test_domtblout_and_fmt6(spark, tmp_path):
    line = "T1 PF1.3 100 q1 - 250 1e-9 1 1 1 1 1e-8 1e-7 1 1 1 1 10 60 8 66 0.9 some words here"
    rows = tabular.read_domtblout(spark, write(tmp_path, f"# c\n{line}\nbad line\n{line.replace(' 10 60 ', ' x 60 ')}\n")).collect()
    assert [(r.target_acc_base, r.qid, r.qlen, r.i_evalue, r.ali_from, r.env_to, r.description) for r in rows] == [("PF1", "q1", 250, 1e-7, 10, 66, "some words here")]
    rows = tabular.read_fmt6(spark, write(tmp_path, "q\tCDD:1\t1e-3\t50\t1\t90\nq\ts\t1\nq\ts\t0\t1\t2\t3\t4\t5\t6\t7\t8\ttitle\t9.5\t-\n")).collect()
    assert [(r.sid, r.qend, r.title, r.qcovs, r.qcovhsp) for r in rows] == [("CDD:1", 90, None, None, None), ("s", 3, "title", 9.5, None)]


def test_lists_scores_folds(spark, tmp_path):
    path = write(tmp_path, "chunk_id\n# c\nPF1.2 x\nPF1.3,y\n\na|chunk_1_of_2\nPF1.2\n")
    assert sorted(r.id for r in tabular.read_ids(spark, path).collect()) == ["PF1.2", "PF1.3", "a|chunk_1_of_2"]
    assert "PF1" in {r.id for r in tabular.read_accessions(spark, path).collect()}
    chunks, whole = tabular.split_ids(tabular.read_ids(spark, path))
    assert chunks.count() == 1 and whole.count() == 2
    path = write(tmp_path, "seq_id\tvalue\na\t3\na\t5\nb\tnan\nc\tinf\nd\t0\n")
    assert {r.seq_id: r.value for r in tabular.read_scores(spark, path).collect()} == {"a": 5.0, "d": 0.0}
    assert {r.seq_id: r.value for r in tabular.read_scores(spark, path, True).collect()} == {"a": 3.0, "d": 1e-300}
    assert {r.seq_id: r.fold for r in tabular.read_folds(spark, path).collect()} == {"a": 5, "d": 0}


def test_other_readers(spark, tmp_path):
    assert [tuple(r) for r in tabular.read_regions(spark, write(tmp_path, "p\tn\t9\t2\n")).collect()] == [("p", "n", 2, 9)]
    ipr = "a\tm\t9\tPfam\ts\td\t1\t5\t1e-3\tT\tx\tIPR1\tname\t-\t-\n"
    assert tabular.read_interpro(spark, write(tmp_path, ipr * 2 + ipr.replace("IPR1", "-") + ipr.replace("Pfam", "Other")), ["Pfam"]).count() == 1
    assert [tuple(r) for r in tabular.read_vectors(spark, write(tmp_path, "a\t1\t2.5\nb\nc\tx\t1\n")).collect()] == [("a", [1.0, 2.5]), ("c", [None, 1.0])]
    (tmp_path / "m.tsv").write_text("chunk_id\torig_id\tchunk_index\tchunks_total\torig_aa_start\torig_aa_end\tchunk_aa_len\torig_aa_len\nc\to\t1\t1\t0\t9\t9\t-\n")
    assert tuple(tabular.read_manifest(spark, str(tmp_path / "m.tsv")).first()) == ("c", "o", 1, 1, 0, 9, 9, None)
    (tmp_path / "o.json").write_text(json.dumps({"_meta": {"x": 1}, "k": {"P": 0.5, "L": 3}, "j": {"P": None}}, indent=1))
    assert sorted(map(tuple, tabular.read_record_objects(spark, str(tmp_path / "o.json"), "P double, L int").collect()), key=str) == [("j", None, None), ("k", 0.5, 3)]
    (tmp_path / "run7.json").write_text(json.dumps({"meta": {"n": 5}, "result": {"seconds": 2.5}, "samples": [{"t_rel_s": 0.5, "process": {"rss_bytes": 7, "cpu_percent": 1.0}}]}))
    runs, samples = tabular.read_runs(spark, str(tmp_path / "run7.json"))
    assert tuple(runs.first()) == ("run7", 5, 2.5) and tuple(samples.first()) == ("run7", 0.5, 7, 1.0)
    (tmp_path / "metrics.json").write_text(json.dumps({"log": [{"epoch": 1, "loss": 0.5}, {"epoch": 2, "loss": 0.4}]}))
    assert tabular.read_training_log(spark, str(tmp_path / "metrics.json"), ["epoch", "loss"]).count() == 2
    with pytest.raises(ValueError):
        tabular.read_training_log(spark, str(tmp_path / "metrics.json"), ["other"])
    pairs = tmp_path / "pairs"
    pairs.mkdir()
    for name in ("x.fasta", "x.attn.json", "y.fasta"):
        (pairs / name).write_text("x")
    assert [r.stem for r in tabular.paired_inputs(spark, str(pairs), {"fasta": ".fasta", "attention": ".attn.json"}).collect()] == ["x"]


def test_arguments(tmp_path, monkeypatch):
    assert tabular.parse_targets("1:A, 2:B") == [("1", "A"), ("2", "B")]
    assert tabular.parse_numbers("0.1,0.5", 0, 1) == [0.1, 0.5]
    for bad in ("1", "1:", "a:b:c"):
        with pytest.raises(ValueError):
            tabular.parse_targets(bad)
    with pytest.raises(ValueError):
        tabular.parse_numbers("2", 0, 1)
    (tmp_path / "w.pt").write_text("")
    assert tabular.resolve_weights(str(tmp_path / "w.pt"), "hub") == str(tmp_path / "w.pt")
    assert tabular.resolve_weights(None, "hub") == "hub"
    with pytest.raises(ValueError):
        tabular.resolve_weights(str(tmp_path / "w.bin"), "hub")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345, [1.0, 2.0]), ("b", None, [3.0, None])], "label string, P double, v array<double>")
    sinks.write_csv(df.select("label", "P"), str(tmp_path / "csv"), {"P": 3})
    assert sorted(line for p in (tmp_path / "csv").glob("*.csv") for line in p.read_text().split())[:2] == ["a,0.123", "b,"]
    sinks.write_matrix(df, str(tmp_path / "m"), "label", "v", 2)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m")).columns == ["label", "v0", "v1"]
    meta = sinks.write_labels(df, str(tmp_path / "l"), {"x": 1})
    assert meta["counts"] == {"a": 1, "b": 1} and meta["hash"] == sinks.write_labels(df.orderBy(F.desc("label")), str(tmp_path / "l2"), {})["hash"]
    assert json.loads(sinks.json_object(df.select("label", "P"), "label", {"schema": 1}))["a"] == {"label": "a", "P": 0.12345}
    sinks.write_edges(spark.createDataFrame([(1, 2, 0.5)], "src int, dst int, weight double"), str(tmp_path / "e"))
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("*.txt")) == "1\t2\t0.500000\n"


def test_windowed_counts(spark, tmp_path):
    spark.sql("select explode(array(1, 61, 62, 4000)) as s").selectExpr("timestamp_seconds(s) as ts", "'k' as k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipeline.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k string")
    out = []
    q = pipeline.windowed_counts(stream, "ts", "1 minute", "0 seconds", "k").writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(r.n for r in b.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out) == [1, 1, 2]


def test_resume(spark):
    todo = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    done = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(r.k or "" for r in pipeline.resume(todo, done, "k").collect()) == ["", "b"]
    assert pipeline.resume(todo, None, "k").count() == 3
