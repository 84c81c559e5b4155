"""Micro-batch pipelines: file streams that are scored batch by batch, best rows as keyed state, and resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files: int = 1, kind: str = "parquet") -> DataFrame:
    """The files of a folder as a stream, so many a micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def run_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append process(batch) to JSON lines in `out`, all that is there now and then stop.

    Each micro-batch writes to its own folder, which a repeated batch overwrites: no row comes twice after a failure.
    """

    def sink(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _best(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else None
    for batch in batches:
        for p, row in zip(batch["P"].tolist(), batch["row"].tolist()):
            rank = float("-inf") if p is None or p != p else p
            # of equal ones the first seen stays
            if best is None or rank > best[0]:
                best = (rank, row)
    state.update(best)
    yield pd.DataFrame([(key[0], None if best[0] == float("-inf") else best[0], best[1])], columns=["key", "P", "row"])


def best_so_far(stream: DataFrame, key: str, p: str, row: str) -> DataFrame:
    """(key, P, row): the best row of each key over all batches so far, for the keys of a micro-batch (update mode)."""
    x = stream.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(p).cast("double").alias("P"), F.col(row).cast("string").alias("row"))
    return x.groupBy("key").applyInPandasWithState(_best, "key string, P double, row string", "P double, row string", "update", GroupStateTimeout.NoTimeout)


def resume(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """The rows that aren't done yet, taken out before anything expensive; rows with a null key stay."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window, with a watermark."""
    x = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return x.groupBy(F.window("__ts", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
