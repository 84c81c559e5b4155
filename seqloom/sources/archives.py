"""Files that are read whole: archives of reports and structure files, each in one task, a row a file or atom."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | Sequence[str]


def _files(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", "content")


def read_archives(spark: SparkSession, paths: Paths, ending: str = ".json") -> DataFrame:
    """(archive, name, text): the files with that ending in tar archives, plain or compressed. Files that aren't UTF-8 have their wrong bytes replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and member.name.endswith(ending):
                            text = tar.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member.name]), pa.array([text])], ["archive", "name", "text"])

    return _files(spark, paths).mapInArrow(run, "archive string, name string, text string")


# The fields of a run report.
RUN = "meta struct<n: bigint>, result struct<seconds: double>, samples array<struct<t_rel_s: double, process: struct<rss_bytes: bigint, cpu_percent: double>>>"


def read_run_archives(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Runs (run, n, seconds) and their samples (run, t, rss, cpu) of the JSON reports in archives."""
    x = read_archives(spark, paths).select(F.regexp_extract("name", r"([^/]+)\.json$", 1).alias("run"), F.from_json("text", RUN).alias("r"))
    samples = x.select("run", F.explode("r.samples").alias("s")).select("run", F.col("s.t_rel_s").alias("t"), F.col("s.process.rss_bytes").alias("rss"), F.col("s.process.cpu_percent").alias("cpu"))
    return x.select("run", F.col("r.meta.n").alias("n"), F.col("r.result.seconds").alias("seconds")), samples


_TOKEN = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(\S+)")


def tokens_of(text: str) -> Iterator[tuple[str, bool]]:
    """(value, quoted) of a structure file: words, quoted texts and texts between lines that begin with `;`; comments are left out."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            held = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                held.append(more)
            yield "\n".join(held).strip(), True
            continue
        for m in _TOKEN.finditer(line):
            word = m[3]
            if word is not None and word.startswith("#"):
                break
            yield (word, False) if word is not None else (m[1] if m[1] is not None else m[2], True)


def category(text: str, name: str) -> list[dict[str, str | None]]:
    """The rows of one category (such as `_atom_site`) of a structure file, as a loop or as single items; `.` and `?` are null."""
    plain = lambda t: None if t in ((".", False), ("?", False)) else t[0]
    items, rows, single = list(tokens_of(text)), [], {}
    i = 0
    while i < len(items):
        word, quoted = items[i]
        if not quoted and word.lower() == "loop_":
            i += 1
            names = []
            while i < len(items) and not items[i][1] and items[i][0].startswith("_"):
                names.append(items[i][0])
                i += 1
            values = []
            while i < len(items) and (items[i][1] or not (items[i][0].startswith(("_", "data_", "save_")) or items[i][0].lower() == "loop_")):
                values.append(items[i])
                i += 1
            if names and names[0].split(".")[0] == name:
                short = [n.split(".", 1)[-1] for n in names]
                rows += [dict(zip(short, map(plain, values[k : k + len(names)]))) for k in range(0, len(values) - len(names) + 1, len(names))]
        elif not quoted and word.startswith("_") and i + 1 < len(items):
            if word.split(".")[0] == name:
                single[word.split(".", 1)[-1]] = plain(items[i + 1])
            i += 2
        else:
            i += 1
    return rows + ([single] if single else [])


def read_structures(spark: SparkSession, paths: Paths, name: str = "_atom_site", fields: Sequence[str] = ("label_entity_id", "auth_asym_id", "label_seq_id", "auth_seq_id")) -> DataFrame:
    """(path, n, fields as text): the rows of a category of structure files, in order; fields that a file doesn't have are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = category(content.decode("utf-8", "replace"), name)
                columns = [pa.array([r.get(f) for r in rows], pa.string()) for f in fields]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *columns], ["path", "n", *fields])

    return _files(spark, paths).mapInArrow(run, ", ".join(["path string", "n bigint", *(f"`{f}` string" for f in fields)]))
