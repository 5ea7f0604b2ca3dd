"""How far a stream of work has come, while it runs.

Results are observed as they pass (``watched``), and a listener adds up what each finished batch saw: a batch that runs again after a failure is reported once.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "work"


def watched(results: DataFrame, failed: str = "error") -> DataFrame:
    """The results, counted as they pass; those with a value in ``failed`` count as failed."""
    return results.observe(OBSERVED, F.count(F.lit(1)).alias("done"), F.count(failed).alias("failed"))


class Progress(StreamingQueryListener):
    """Sums over all batches of the queries that are watched: arrived, done and failed, and the seconds that are left.

    ``total`` is how many will arrive if that's known, else as many as have arrived. Use as a context, so that the session forgets it at the end.
    """

    def __init__(self, spark: SparkSession, total: int | None = None) -> None:
        super().__init__()
        self.spark, self._total, self._lock = spark, total, threading.Lock()
        self.arrived = self.done = self.failed = 0
        self.since: float | None = None

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    @property
    def total(self) -> int:
        return max(self.arrived, self._total or 0)

    def seconds_left(self, now: float | None = None) -> float | None:
        """Time so far for each one done, times those that aren't; null before the first, 0 at the end."""
        with self._lock:
            if not self.done or self.since is None:
                return None
            return ((now or time.time()) - self.since) / self.done * max(0, self.total - self.done)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.since = self.since or time.time()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(OBSERVED)
        if seen is None:
            return
        with self._lock:
            self.arrived += event.progress.numInputRows
            self.done += seen.done
            self.failed += seen.failed

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
