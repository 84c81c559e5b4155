"""The interval map as keyed state of a streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.coverage import IntervalMap, trimmed


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
    for batch in batches:
        for start, end in zip(batch["s"].tolist(), batch["e"].tolist()):
            held.insert(start, end)
    state.update((held.starts, held.ends))
    rows = [("period", *x) for x in held.periods()] + [("gap", *x) for x in held.gaps()]
    yield pd.DataFrame([(key[0], len(held.starts), *x) for x in rows], columns=["key", "periods", "kind", "s", "e"])


def stream_periods(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """A streaming frame of intervals to the periods and gaps of every key touched by a micro-batch (update mode).

    Nulls, reversed ends and blanks around keys are treated as in operators.coverage.periods_and_gaps. Each
    micro-batch gives the complete present map of its keys, so the last rows of a key are its result.
    """
    rows = df.select(
        trimmed(F.col(f"`{key}`").cast("string")).alias("key"),
        F.least(start, end).cast("bigint").alias("s"),
        F.greatest(start, end).cast("bigint").alias("e"),
    ).filter(F.col("key").isNotNull() & F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull())
    return rows.groupBy("key").applyInPandasWithState(
        _update,
        "key string, periods bigint, kind string, s bigint, e bigint",
        "starts array<bigint>, ends array<bigint>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
