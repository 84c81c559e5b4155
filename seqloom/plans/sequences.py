"""Queries over sequences and identifiers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling
from ..operators.ranking import best_rows
from ..operators.windows import chunked
from ..session import table


def f1_sanitise(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    return table(spark, d, "fasta_records").select("rec_id", T.sanitised(s).alias("clean"), F.length(T.strip_blanks(s)).cast("bigint").alias("raw_len"), T.fixed_count(s).cast("bigint").alias("n_fixed"))


def f2_printable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fasta_records").select("rec_id", T.printable(F.col("seq")).alias("clean"))


def f3_keys(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq_id")
    return table(spark, d, "fasta_records").select("rec_id", T.storage_key(s).alias("storage_key"), T.safe_id(s, 20).alias("safe_id"), T.sequence_hash(F.col("seq")).alias("seq_sha256"))


def f6_base_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_manifest").select("row_id", T.base_id(F.col("chunk_id")).alias("base_id"))


def f7_parse_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chunk_manifest").select("row_id", T.parsed_chunk(F.col("chunk_id")).alias("p"))
    return x.select("row_id", F.col("p.parent").alias("parent"), *(F.col(f"p.{c}").cast("bigint").alias(f"c_{c}") for c in ("index", "total", "start", "end")))


def f8_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "chunk_manifest").filter("orig_id is not null and aa_end is not null")
    c = [F.col(n) for n in ("orig_id", "chunk_index", "chunks_total", "aa_start", "aa_end")]
    return x.select("row_id", T.chunk_id(*c).alias("chunk_id"), T.chunk_id(*c, widen=True).alias("wide_id"))


def f16_fold(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").filter("seq_id is not null")
    return x.select("rec_id", T.fold_of(F.col("seq_id"), 5, 1).alias("fold"))


def f18_assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").select("rec_id", "path", "ord")
    return sampling.assigned_ids(x, ["path", "ord", "rec_id"], "SEQ").select("rec_id", "new_id")


def f29_accessions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "hmmer_dom_hits")
    return x.select("hit_id", T.accession_base(F.col("target_acc")).alias("acc"), T.domain_label(F.col("description"), F.col("target_name")).alias("label"))


def pred1_strict(spark: SparkSession, d: str) -> DataFrame:
    """Records that pass: at least 8 residues, at most a fifth of them changed."""
    x = f1_sanitise(spark, d)
    return x.filter("raw_len >= 8 and n_fixed / raw_len <= 0.20")


def a11_sanitise_counts(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce((F.col("raw_len") >= 8) & (F.col("n_fixed") / F.nullif(F.col("raw_len"), F.lit(0)) <= 0.20), F.lit(False))
    x = f1_sanitise(spark, d)
    return x.agg(F.count_if(ok).alias("kept"), F.count_if(ok & (F.col("n_fixed") > 0)).alias("fixed"), F.count_if(~ok).alias("dropped"))


def pred5_length_range(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").select("rec_id", F.length(T.strip_blanks(F.col("seq"))).cast("bigint").alias("len"))
    return x.filter(F.col("len").between(100, 1000))


def sc8_last_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """One sequence an id, the last read."""
    x = table(spark, d, "fasta_records").filter("seq_id is not null").select("seq_id", "rec_id", F.sha2("seq", 256).alias("sha"))
    return best_rows(x, ["seq_id"], [F.desc("rec_id")])


def w12_chunks_package(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "package")


def w13_chunks_grid(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "grid")


def _chunks(spark: SparkSession, d: str, mode: str) -> DataFrame:
    x = table(spark, d, "fasta_records").select("rec_id", T.sanitised(F.col("seq")).alias("seq"))
    c = chunked(x, "seq", 300, 48, mode)
    return c.select("rec_id", *(F.col(n).cast("bigint").alias(n) for n in ("chunk_index", "chunks_total", "aa_start", "aa_end")), F.md5("chunk").alias("chunk_md5"))


def w13_document_windows(spark: SparkSession, d: str) -> DataFrame:
    c = chunked(table(spark, d, "documents").select("doc_id", "text"), "text", 400, 80)
    return c.select("doc_id", F.col("aa_start").cast("bigint").alias("c_from"), F.col("aa_end").cast("bigint").alias("c_to"), F.length("chunk").cast("bigint").alias("len"))


def l3_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 sequences of 50 to 2,000 residues."""
    x = table(spark, d, "fasta_records").select("rec_id", "seq")
    return sampling.sample(x, ["rec_id"], 100, 7, F.length("seq"), 50, 2000).select("rec_id")


def l4_samples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.samples(table(spark, d, "fasta_records"), "rec_id", [20, 50], 3)


def l5_parts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.parts_of(table(spark, d, "fasta_records").select("rec_id"), ["rec_id"], 250)


def l6_fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fasta_records").filter("seq_id is not null")
    return x.groupBy(T.fold_of(F.col("seq_id"), 5, 1).alias("fold")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"))


def l7_grouped_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "label_table").select("row_id", T.base_id(F.trim("ids")).alias("base_id"))
    return sampling.grouped_split(x, "base_id", 0.8, 0.1, 3)


def l12_mutants(spark: SparkSession, d: str) -> DataFrame:
    """All modes on every sequence, a tenth of the positions, acidic residues protected."""
    x = table(spark, d, "fasta_records").select("rec_id", T.sanitised(F.col("seq")).alias("seq"))
    return sampling.mutants(x, "rec_id", "seq", sampling.MODES, [0.1], 1, 1, "DE")


QUERIES = {
    f.__name__: f
    for f in (
        f1_sanitise, f2_printable, f3_keys, f6_base_id, f7_parse_chunk_id, f8_chunk_id, f16_fold, f18_assigned_ids, f29_accessions, pred1_strict, a11_sanitise_counts, pred5_length_range, sc8_last_duplicate,
        w12_chunks_package, w13_chunks_grid, w13_document_windows, l3_sample, l4_samples, l5_parts, l6_fold_sizes, l7_grouped_split, l12_mutants,
    )
}

_S = "regexp_replace(upper(seq), '[ \\t\\r\\n]', '', 'g')"
_CLEAN = f"select rec_id, regexp_replace({_S}, '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g') as clean, length({_S})::bigint as raw_len, length(regexp_replace({_S}, '[ACDEFGHIKLMNPQRSTVWYX]', '', 'g'))::bigint as n_fixed from fasta_records"
_BASE = "case when contains({0}, '|chunk_') then split_part({0}, '|chunk_', 1) when contains({0}, '_chunk_') then split_part({0}, '_chunk_', 1) else {0} end"
_FOLD = "(('0x' || substr(sha1('1' || chr(9) || seq_id), 1, 16))::ubigint % 5)::int"


def _windows(source: str, key: str, text: str, size: int, overlap: int, mode: str) -> str:
    """CTEs up to w(key, text, n, i, s, e)."""
    step = size - overlap
    start = f"least(i * {step}, greatest(n - {size}, 0))" if mode == "grid" else f"i * {step}"
    return f"""
with b as (select {key}, {text} as t from {source}), l as (select {key}, t, length(t) as n from b where length(t) > 0),
x as (select *, unnest(range(0, case when n <= {size} then 1 else ceil((n - {size}) / {step})::bigint + 1 end)) as i from l),
w as (select *, ({start})::bigint as s, least({start} + {size}, n)::bigint as e from x)
"""


_C = f"regexp_replace({_S}, '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g')"
_W = "select rec_id, (i + 1)::bigint as chunk_index, {0} as chunks_total, s as aa_start, e as aa_end, md5(substr(t, s + 1, e - s)) as chunk_md5 from w"
_L, _H = "'^(.*?)[|_]chunk_(\\d+)_of_(\\d+)[|_]aa_(\\d+)_(\\d+)$'", "'^(.*?)[|_]chunk_(\\d+)_of_(\\d+)$'"
SQL = {
    "f1_sanitise": _CLEAN,
    "f2_printable": "select rec_id, regexp_replace(upper(seq), '[^\\x21-\\x7E]|\\*', '', 'g') as clean from fasta_records",
    "f3_keys": """
with x as (select rec_id, seq, seq_id, left(translate(trim(seq_id), '<>:"/\\|?*' || chr(9) || chr(13) || chr(10), '____________'), 240) as k,
  regexp_replace(seq_id, '[^A-Za-z0-9_.|:+-]+', '_', 'g') as p from fasta_records)
select rec_id, coalesce(nullif(k, ''), 'unnamed') as storage_key,
  case when length(p) <= 20 then p else left(p, 9) || '_' || left(sha1(seq_id), 10) end as safe_id, sha256(seq) as seq_sha256 from x""",
    "f6_base_id": "select row_id, " + _BASE.format("chunk_id") + " as base_id from chunk_manifest",
    "f7_parse_chunk_id": f"""
select row_id, case when regexp_matches(chunk_id, {_L}) then regexp_extract(chunk_id, {_L}, 1) when regexp_matches(chunk_id, {_H}) then regexp_extract(chunk_id, {_H}, 1) end as parent,
  try_cast(case when regexp_matches(chunk_id, {_L}) then regexp_extract(chunk_id, {_L}, 2) else regexp_extract(chunk_id, {_H}, 2) end as bigint) as c_index,
  try_cast(case when regexp_matches(chunk_id, {_L}) then regexp_extract(chunk_id, {_L}, 3) else regexp_extract(chunk_id, {_H}, 3) end as bigint) as c_total,
  try_cast(regexp_extract(chunk_id, {_L}, 4) as bigint) as c_start, try_cast(regexp_extract(chunk_id, {_L}, 5) as bigint) as c_end from chunk_manifest""",
    "f8_chunk_id": """
select row_id, printf('%s|chunk_%04d_of_%04d|aa_%06d_%06d', orig_id, chunk_index, chunks_total, aa_start, aa_end) as chunk_id,
  orig_id || '|chunk_' || lpad(chunk_index::varchar, greatest(4, length(chunks_total::varchar))::int, '0') || '_of_' || lpad(chunks_total::varchar, greatest(4, length(chunks_total::varchar))::int, '0')
  || printf('|aa_%06d_%06d', aa_start, aa_end) as wide_id
from chunk_manifest where orig_id is not null and aa_end is not null""",
    "f16_fold": f"select rec_id, {_FOLD} as fold from fasta_records where seq_id is not null",
    "f18_assigned_ids": """
select rec_id, 'SEQ_' || lpad((row_number() over (order by path nulls first, ord nulls first, rec_id))::varchar, greatest(4, length((select count(*) from fasta_records)::varchar))::int, '0') as new_id from fasta_records""",
    "f29_accessions": """
select hit_id, regexp_replace(trim(target_acc), '\\.\\d+$', '') as acc,
  trim(regexp_replace(coalesce(case when trim(description) not in ('', '-') then description end, case when trim(target_name) not in ('', '-') then target_name end), '\\s+', ' ', 'g')) as label
from hmmer_dom_hits""",
    "pred1_strict": f"select * from ({_CLEAN}) where raw_len >= 8 and n_fixed / raw_len <= 0.20",
    "a11_sanitise_counts": f"""
with c as (select coalesce(raw_len >= 8 and n_fixed / nullif(raw_len, 0) <= 0.20, false) as ok, n_fixed from ({_CLEAN}))
select count(*) filter (where ok) as kept, count(*) filter (where ok and n_fixed > 0) as fixed, count(*) filter (where not ok) as dropped from c""",
    "pred5_length_range": f"select rec_id, length({_S})::bigint as len from fasta_records where length({_S}) between 100 and 1000",
    "sc8_last_duplicate": "select seq_id, max(rec_id) as rec_id, sha256(nullif(arg_max(seq, rec_id), chr(1))) as sha from (select seq_id, rec_id, coalesce(seq, chr(1)) as seq from fasta_records) where seq_id is not null group by seq_id",
    "w12_chunks_package": _windows("fasta_records", "rec_id", _C, 300, 48, "package") + _W.format("ceil(n / 300)::bigint"),
    "w13_chunks_grid": _windows("fasta_records", "rec_id", _C, 300, 48, "grid") + _W.format("count(*) over (partition by rec_id)::bigint"),
    "w13_document_windows": _windows("documents", "doc_id", "text", 400, 80, "grid") + "select doc_id, s as c_from, e as c_to, (e - s)::bigint as len from w",
    "l3_sample": "select rec_id from fasta_records where length(seq) between 50 and 2000 order by md5('7' || chr(9) || rec_id), rec_id limit 100",
    "l4_samples": """
with p as (select rec_id, s.size, r.replicate from fasta_records, (values (20), (50)) s(size), (values (1), (2), (3)) r(replicate)),
n as (select size, replicate, rec_id, row_number() over (partition by size, replicate order by md5((size * 1000 + replicate)::varchar || chr(9) || rec_id), rec_id)::int as n from p)
select size::int as size, replicate::int as replicate, rec_id, n from n where n <= size""",
    "l5_parts": "select rec_id, ((row_number() over (order by rec_id) - 1) // 250)::bigint as part from fasta_records",
    "l6_fold_sizes": f"select {_FOLD} as fold, count(*) as n, sum(length(seq))::bigint as letters from fasta_records where seq_id is not null group by 1",
    "l7_grouped_split": f"""
with x as (select row_id, {_BASE.format("trim(ids)")} as base_id from label_table), g as (select distinct base_id from x),
n as (select base_id, row_number() over (order by md5('3' || chr(9) || coalesce(base_id, '')), base_id) - 1 as i, count(*) over () as c from g)
select x.row_id, x.base_id, case when i < floor(c * 0.8) then 'train' when i < floor(c * 0.8) + floor(c * 0.1) then 'val' else 'test' end as split
from x join n on x.base_id is not distinct from n.base_id""",
}
