"""The whole chain: FASTA files to predictions, features and JSON, as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import text as T
from .operators.model import Embedder, Weights, score_chunks
from .operators.ranking import best_rows, not_nan
from .operators.windows import chunked
from .session import checkpoint
from .settings import Options
from .sources import fasta, sinks

_EMBEDDERS: dict[tuple, Embedder] = {}


def cached_embedder(key: tuple, make: Callable[[], Embedder]) -> Embedder:
    """One embedder for each key (such as model and device) and Python process."""
    if key not in _EMBEDDERS:
        _EMBEDDERS[key] = make()
    return _EMBEDDERS[key]


def sanitised_records(spark: SparkSession, paths: str | Sequence[str], options: Options = Options()) -> DataFrame:
    """(seq_id, seq, length, fixed) of FASTA files: upper case, unknown residues X; records without sequence left out.

    With strict, only records of at least least_length residues with at most most_fixed of them changed are kept.
    Of repeated ids the last one counts.
    """
    x = fasta.read_fasta(spark, paths, empty="drop")
    x = x.select("seq_id", "path", "ord", T.sanitised(F.col("seq")).alias("seq"), T.fixed_count(F.col("seq")).alias("fixed")).withColumn("length", F.length("seq"))
    if options.strict:
        x = x.filter((F.col("length") >= options.least_length) & (F.col("fixed") / F.nullif(F.col("length"), F.lit(0)) <= options.most_fixed))
    return best_rows(x, ["seq_id"], [F.desc("path"), F.desc("ord")]).select("seq_id", "seq", "length", "fixed")


def chunks(records: DataFrame, options: Options = Options()) -> DataFrame:
    """(chunk_id, base_id, aa_start, orig_len, chunk): windows of chunk_len that overlap by chunk_overlap."""
    x = chunked(records.select("seq_id", "seq", F.col("length").alias("orig_len")), "seq", options.chunk_len, options.chunk_overlap, "package")
    name = T.chunk_id(F.col("seq_id"), F.col("chunk_index"), F.greatest("chunks_total", "chunk_index"), F.col("aa_start"), F.col("aa_end"))
    return x.select(name.alias("chunk_id"), F.col("seq_id").alias("base_id"), "aa_start", "orig_len", "chunk")


def predictions(pieces: DataFrame, embed: Embedder, weights: Weights, options: Options = Options()) -> DataFrame:
    """Each chunk with its prediction, its span on the whole sequence (start and end, 1-based) and whether it is the best of its sequence."""
    p = score_chunks(pieces, "chunk_id", "chunk", embed, weights, options.most_tokens, options.tries)
    x = p.join(pieces.select("chunk_id", "base_id", "aa_start", "orig_len"), "chunk_id")
    start, end = (F.col("aa_start") + F.col(c) + 1 for c in ("S_idx", "E_idx"))
    x = checkpoint(x.withColumn("start", start).withColumn("end", end).withColumn("entropy", N.entropy(F.col("w"))))
    best = x.groupBy("base_id").agg(F.max_by("chunk_id", F.struct(not_nan(F.col("P")), F.col("chunk_id"))).alias("chunk_id")).withColumn("is_best_base_chunk", F.lit(True))
    return x.join(best, ["base_id", "chunk_id"], "left").withColumn("is_best_base_chunk", F.coalesce("is_best_base_chunk", F.lit(False)))


def base_features(predicted: DataFrame, least_p: float = 0.0) -> DataFrame:
    """The best chunk of each sequence whose P is at least least_p, in the order of their names."""
    return predicted.filter(F.col("is_best_base_chunk") & (F.col("P") >= least_p)).orderBy("base_id")


def fasta_to_features(
    spark: SparkSession, paths: str | Sequence[str], embed: Embedder, weights: Weights, gff: str | None = None, attention: str | None = None, logits: str | None = None, options: Options = Options(), mode: str = "errorifexists"
) -> DataFrame:
    """FASTA files to features: reads, cleans, cuts, embeds, scores and keeps the best chunk of each sequence.

    gff: a folder for features; attention, logits: folders for JSON lines of all chunks with weights, and of their
    logits. Returns the features. Chunks that couldn't be embedded have no prediction and are no features.
    """
    x = predictions(chunks(sanitised_records(spark, paths, options), options), embed, weights, options)
    found = base_features(x, options.least_p)
    meta = {"temperature": weights.temperature, "chunk_len": options.chunk_len, "chunk_overlap": options.chunk_overlap}
    if gff:
        sinks.write_gff3(found.withColumn("length", F.col("orig_len")).withColumn("sigma", F.col("sigma_attn")), gff, mode, full=True, least_p=options.least_p, temperature=weights.temperature, hpd=False)
    if attention:
        at = F.transform(F.sequence(F.lit(0), F.col("L") - 1), lambda i: i + F.col("aa_start"))
        full = x.filter("error is null").select("chunk_id", "base_id", "L", F.col("aa_start").alias("orig_start"), "orig_len", "mu", "sigma", "mu_attn", "sigma_attn", "S_norm", "E_norm", "S_idx", "E_idx", "P", "logit", "calibrated_logit", F.lit(weights.temperature).alias("temperature"), "w", at.alias("abs_pos"), "is_best_base_chunk")
        sinks.write_json(full, attention, meta, mode)
    if logits:
        sinks.write_json(x.filter("error is null").select("chunk_id", "base_id", "P", "logit", "calibrated_logit", F.lit(weights.temperature).alias("temperature"), "is_best_base_chunk"), logits, meta, mode)
    return found
