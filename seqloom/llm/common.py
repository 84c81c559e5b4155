"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

BLANKS = " \t\r\n\f\v"
#: Most rows of a side that is broadcast.
MOST_BROADCAST = 20_000


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, written down and counted; marked for broadcast only if it has at most `most` rows, else joined as any other."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most else df


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
