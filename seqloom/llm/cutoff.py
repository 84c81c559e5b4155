"""Score cutoffs that keep a target fraction of each source.

Records are sorted within each source by score and identifier, over range partitions, so that neither a large
source nor a large group of equal scores lies in one task. The rows of each (source, partition) are counted, the
counts are summed along the sort order, and so the exact position of every record is known up to its place in
its own partition; only the one partition that holds the target position is numbered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import finite, small, trimmed


def _records(scores: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, id, k), k small for good and null without a finite value; and the totals with the target counts."""
    value = F.col("value").cast("double")
    rows = scores.select(F.col("source").alias("source"), trimmed(F.col("seq_id")).alias("id"), value.alias("value"))
    # adding 0.0 makes of -0.0 a plain 0.0
    k = F.when(finite(F.col("value")), F.when(F.col("metric") == "evalue", F.col("value")).otherwise(-F.col("value")) + F.lit(0.0))
    records = (
        rows.filter(F.col("id").isNotNull() & F.col("source").isNotNull())
        .join(targets.select("source", "metric"), "source")
        .groupBy("source", "id")
        .agg(F.min(k).alias("k"))
    )
    return records


def _target_count(total, fraction):
    """The largest whole n with n / total <= fraction, in double arithmetic as the fraction is checked."""
    guess = F.floor(total * fraction)
    n = guess + 1
    fits = lambda x: (x / total) <= fraction
    found = F.when(fits(n), n).when(fits(n - 1), n - 1).otherwise(n - 2)
    return F.least(total, F.greatest(F.lit(0), F.when(fraction.isNull() | F.isnan(fraction), F.lit(0)).otherwise(found))).cast("bigint")


def cutoffs(scores: DataFrame, targets: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept records (source, id) and the report (source, metric, target, threshold, kept, total, fraction).

    scores: source, seq_id, value. targets: source (unique), metric (`evalue`: low is good, else high), fraction.

    A record is a distinct trimmed seq_id of a source, its value the best of its finite ones; a record without
    a finite value is never kept but counts in the total. Kept are all records at least as good as the most
    lenient value with kept / total <= fraction; equal values are kept or dropped together, perhaps none. Null
    seq_ids and sources are no records, sources without a target have no rows, a null or NaN fraction keeps
    nothing, and where nothing is kept the threshold is null. Sources without records report a total of 0.
    """
    spark = scores.sparkSession
    targets = small(targets.select("source", "metric", F.col("fraction").cast("double").alias("fraction")))
    records = _records(scores, targets)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written down, as partition numbers must not change between the uses.
    ordered = checkpoint(
        records.repartitionByRange(n, "source", F.col("k").asc_nulls_last(), "id")
        .sortWithinPartitions("source", F.col("k").asc_nulls_last(), "id")
        .withColumn("part", F.spark_partition_id())
    )
    counts = ordered.groupBy("source", "part").agg(F.count("*").alias("rows"), F.count("k").alias("finite"))
    counts = checkpoint(counts)
    totals = counts.groupBy("source").agg(F.sum("rows").alias("total"))
    wanted = totals.join(targets, "source").select("source", "total", _target_count(F.col("total"), F.col("fraction")).alias("wanted"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("source", "part", "finite", F.coalesce(F.sum("finite").over(before), F.lit(0)).alias("ahead"))
    # The first record beyond the target count: only strictly better ones are kept, which leaves ties whole.
    home = small(
        places.join(wanted, "source")
        .filter("wanted >= ahead and wanted < ahead + finite")
        .select("source", "part", (F.col("wanted") - F.col("ahead") + 1).alias("place"))
    )
    place = Window.partitionBy("source", "part").orderBy("k", "id")
    beyond = (
        ordered.filter("k is not null")
        .join(home, ["source", "part"])
        .withColumn("n", F.row_number().over(place))
        .filter("n = place")
        .select("source", F.col("k").alias("bound"))
    )
    bounds = small(wanted.join(beyond, "source", "left").select("source", "total", "bound"))
    kept = ordered.join(bounds, "source").filter("k is not null and (bound is null or k < bound)")
    got = kept.groupBy("source").agg(F.count("*").alias("kept"), F.max("k").alias("worst"))
    report = (
        targets.join(totals, "source", "left")
        .join(got, "source", "left")
        .select(
            "source",
            "metric",
            F.col("fraction").alias("target"),
            F.when(F.col("metric") == "evalue", F.col("worst")).otherwise(F.lit(0.0) - F.col("worst")).alias("threshold"),
            F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"),
            F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
            F.when(F.col("total") > 0, F.coalesce("kept", F.lit(0)) / F.col("total")).alias("fraction"),
        )
    )
    return kept.select("source", F.col("id").alias("seq_id")), report
