"""Progress of streaming queries: rows, rate and what is left, by a listener."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("seqloom")


class Progress(StreamingQueryListener):
    """Adds up the rows of all micro-batches and reports them. expected: rows in all, for the time that is left."""

    def __init__(self, expected: int | None = None, report: Callable[[str], None] = log.info, clock: Callable[[], float] = time.monotonic):
        self.expected, self.report, self.clock = expected, report, clock
        self.rows, self.batches, self.began = 0, 0, clock()

    def add(self, rows: int) -> str:
        """Count a micro-batch and say where the work stands."""
        self.rows += rows
        self.batches += 1
        took = max(self.clock() - self.began, 1e-9)
        rate = self.rows / took
        text = f"{self.rows} rows in {self.batches} batches, {rate:.1f} rows/s"
        if self.expected and rate > 0:
            text += f", {max(0, self.expected - self.rows) / rate:.0f} s left"
        return text

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.began = self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.report(self.add(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.report(f"ended after {self.rows} rows")
