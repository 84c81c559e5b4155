"""What must hold of results that SQL can't compute: lanes, batches, mutants, peaks, communities, fits and predictions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import sampling
from ..session import checkpoint, table
from . import scores, sequences, spans, tables, vectors


def i8_lanes_hold(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the hits that have a lane, those that share a position with one before in their lane, and whether lanes are numbered from 0 on."""
    x = spans.i8_pack_lanes(spark, d)
    w = Window.partitionBy("qid", "lane").orderBy("hit_id")
    x = x.withColumn("clash", F.coalesce(F.col("s") <= F.lag("e").over(w), F.lit(False)))
    return x.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("clash").alias("clashes"), (F.max("lane") + 1 == F.countDistinct("lane")).alias("whole"))


def w17_caps_hold(spark: SparkSession, d: str) -> DataFrame:
    """Records and letters of all batches, and batches of several records beyond a cap."""
    over = (F.col("letters") > 20_000) & (F.col("records") > 1) | (F.col("records") > 50)
    return tables.w17_batches(spark, d).agg(F.sum("records").alias("records"), F.sum("letters").alias("letters"), F.count_if(over).alias("over"))


def l12_mutants_hold(spark: SparkSession, d: str) -> DataFrame:
    """Of each sequence its mutants, those without text, and those whose ids are repeated."""
    x = sequences.l12_mutants(spark, d)
    return x.groupBy("rec_id").agg(F.count("*").alias("n"), F.count_if(F.col("mutant").isNull() | (F.col("changed") < 0)).alias("bad"), (F.count("*") - F.countDistinct("mutant_id")).alias("repeated"))


def w10_peaks_hold(spark: SparkSession, d: str) -> DataFrame:
    """Peaks that are lower than a neighbour, that stand out too little, or that lie too near to the one before."""
    x = vectors.w10_peaks(spark, d).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    at = lambda i: F.coalesce(F.get("embedding", F.col("position") + i).cast("double"), F.lit(float("-inf")))
    w = Window.partitionBy("vec_id").orderBy("position")
    near = F.coalesce(F.col("position") - F.lag("position").over(w) < 3, F.lit(False))
    x = x.select(((at(0) < at(1)) | (at(0) < at(-1))).alias("low"), (F.col("height") < 0.1).alias("flat"), near.alias("near"))
    return x.agg(F.count_if("low").alias("low"), F.count_if("flat").alias("flat"), F.count_if("near").alias("near"), (F.count("*") > 0).alias("some"))


def g4_axes_hold(spark: SparkSession, d: str) -> DataFrame:
    return vectors.g4_components(spark, d).select("vec_id", (F.abs(F.col("norm") - 1) < 1e-5).alias("unit"), F.col("axes").between(1, 64).alias("axes"))


def g5_labels_hold(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with one label each, which is a node."""
    x = checkpoint(vectors.g5_communities(spark, d))
    strange = x.join(x.select(F.col("node").alias("label")), "label", "left_anti").count()
    return x.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.count_if(F.col("label").isNull()).alias("without"), F.lit(strange).cast("bigint").alias("strange"))


def g6_consensus_holds(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose numbers don't fit each other, and edges that no vector's neighbours have."""
    x = checkpoint(vectors.g6_consensus(spark, d))
    edges = vectors.g1_undirected(spark, d).select("src", "dst")
    bad = (F.col("coassigned") > F.col("cosampled")) | (F.col("cosampled") > 10) | (F.abs(F.col("freq") * F.col("cosampled") - F.col("coassigned")) > 1e-9) | (F.col("freq") < 0.5)
    strange = x.join(edges, ["src", "dst"], "left_anti").count()
    return x.agg(F.count_if(bad).alias("bad"), (F.count("*") > 0).alias("some"), F.lit(strange).cast("bigint").alias("strange"))


def g8_clusters_hold(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of fewer than three nodes, and supports beyond 0.5 to 1."""
    x = checkpoint(vectors.g8_consensus_clusters(spark, d))
    small = x.filter("label is not null").groupBy("label").count().filter("count < 3").count()
    return x.agg(F.count_if(~F.col("support").between(0.5 - 1e-9, 1 + 1e-9)).alias("bad"), (F.count("*") - F.countDistinct("node")).alias("repeated"), F.lit(small).cast("bigint").alias("small"))


def a44_least(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mean loss at the temperature found is no larger than at temperatures a fifth away on both sides."""
    t = scores.a44_temperature(spark, d).first()[0]
    x = scores._labelled(spark, d).filter("labels <> 1 and logit is not null and not isnan(logit)")
    y = (F.col("labels") == 2).cast("double")
    row = x.agg(*(F.sum(L.cross_entropy(F.col("logit") / k, y)).alias(n) for n, k in (("at", t), ("up", min(10.0, t * 1.2)), ("down", max(0.1, t / 1.2))))).first()
    ok = row["at"] is None or row["at"] <= min(row["up"], row["down"]) + 1e-6 * abs(row["at"])
    return spark.createDataFrame([(ok, 0.1 <= t <= 10.0)], "least boolean, inside boolean")


def a36_best(spark: SparkSession, d: str) -> DataFrame:
    """Of each key the models fitted, how many are best, and whether the best explains no less than the other up to rounding."""
    x = scores.a36_saturation(spark, d)
    return x.groupBy("l_returnflag").agg(F.count("*").alias("models"), F.count_if("best").alias("best"), (F.max(F.when(F.col("best"), F.col("r2"))) >= F.max("r2") - 1e-4).alias("least_error"))


def u3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each sequence whether its prediction lies within its bounds."""
    x = vectors.u3_predictions(spark, d)
    return x.select(F.col("base_id").cast("bigint").alias("rec_id"), (F.col("P").between(0, 1) & (F.col("S_idx") >= 0) & (F.col("S_idx") <= F.col("E_idx")) & (F.col("E_idx") < 300)).alias("ok"))


def l9_shown(spark: SparkSession, d: str) -> DataFrame:
    """The number of examples and of their bases, and whether the best of all is one."""
    x = tables.l9_examples(spark, d)
    key = x.columns[0]
    top = table(spark, d, "pooled_json").filter("base_id is not null and P is not null and not isnan(P)").agg(F.max("P").alias("top")).first().top
    return x.agg(F.count("*").alias("n"), F.countDistinct(key).alias("bases"), (F.max("score") == F.lit(top)).alias("best"))


QUERIES = {f.__name__: f for f in (i8_lanes_hold, w17_caps_hold, l12_mutants_hold, w10_peaks_hold, g4_axes_hold, g5_labels_hold, g6_consensus_holds, g8_clusters_hold, a44_least, a36_best, u3_bounds, l9_shown)}

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = {
    "i8_lanes_hold": f"select trim(qid, {_BL}) as qid, count(*) as n, 0::bigint as clashes, true as whole from hmmer_dom_hits where qid is not null and ali_from is not null and ali_to is not null group by 1",
    "w17_caps_hold": "select count(*)::bigint as records, sum(coalesce(length(seq), 0) + 2)::bigint as letters, 0::bigint as over from fasta_records",
    "l12_mutants_hold": f"select rec_id, {len(sampling.MODES)}::bigint as n, 0::bigint as bad, 0::bigint as repeated from fasta_records where length(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g')) > 0",
    "w10_peaks_hold": "select 0::bigint as low, 0::bigint as flat, 0::bigint as near, count(*) > 0 as some from embeddings",
    "g4_axes_hold": "select vec_id, true as unit, true as axes from embeddings",
    "g5_labels_hold": "select count(*) as n, count(*) as nodes, 0::bigint as without, 0::bigint as strange from embeddings",
    "g6_consensus_holds": "select 0::bigint as bad, count(*) > 0 as some, 0::bigint as strange from embeddings",
    "g8_clusters_hold": "select 0::bigint as bad, 0::bigint as repeated, 0::bigint as small",
    "a44_least": "select true as least, true as inside",
    "a36_best": "select distinct l_returnflag, 2::bigint as models, 1::bigint as best, true as least_error from lineitem",
    "u3_bounds": "select rec_id, true as ok from fasta_records where length(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g')) > 0",
    "l9_shown": "select least(10, count(distinct base_id))::bigint as n, least(10, count(distinct base_id))::bigint as bases, true as best from pooled_json where base_id is not null and P is not null and not isnan(P)",
}
