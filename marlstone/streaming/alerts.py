"""Alerts for users who fall silent: state and event-time timers of our own for each user, kept in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Silence(StatefulProcessor):
    """A user's state is a list of runs, stretches of events at most gap apart that the watermark hasn't passed yet: no
    more than the watermark's delay holds gaps, however many events there are. A user has one timer, at the end of the run
    that is over first plus the gap. Late rows may lengthen or join runs until then, so a timer that fires counts for all
    runs that the watermark shows to be over, and sets the timer of the next."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "starts array<long>, ends array<long>, counts array<long>")

    def _due(self, end: int) -> int:
        return -(-(end + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = list(zip(*self.runs.get())) if self.runs.exists() else []
        for batch in rows:
            micros = np.sort(batch["micros"].to_numpy())
            cuts = np.flatnonzero(np.diff(micros) > self.gap) + 1
            first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(micros)]])
            runs = self._joined(runs + list(zip(micros[first].tolist(), micros[last - 1].tolist(), (last - first).tolist())))
        self.runs.update(tuple(map(list, zip(*runs))))
        self.handle.registerTimer(min(self._due(end) for _, end, _ in runs))
        return iter(())

    def _joined(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for start, end, n in sorted(runs):
            if out and start - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
            else:
                out.append((start, end, n))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        runs = list(zip(*self.runs.get())) if self.runs.exists() else []
        over = [r for r in runs if self._due(r[1]) <= now]
        left = [r for r in runs if self._due(r[1]) > now]
        if left:
            self.handle.registerTimer(min(self._due(end) for _, end, _ in left))
        if over:
            self.runs.update(tuple(map(list, zip(*left)))) if left else self.runs.clear()
            yield pd.DataFrame([(key[0], *r) for r in over], columns=["user_id", "began", "ended", "n"])

    def close(self) -> None:
        pass


def silences(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """user_id, began, ended, n: each run of a user's events that nothing followed for longer than gap, as soon as the
    watermark (late behind the latest event) shows it.

    Rows without a user or time are left out, rows later than the watermark too; repeated rows count each. A run that the
    watermark hasn't passed isn't reported yet. Start the stream within rocksdb(), in append mode."""
    milliseconds = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return (
        rows
        .select("user_id", "ts", F.unix_micros("ts").alias("micros"))
        .groupBy("user_id")
        .transformWithStateInPandas(Silence(milliseconds), "user_id long, began long, ended long, n long", "append", "eventTime")
        .select("user_id", *(F.timestamp_micros(c).alias(c) for c in ("began", "ended")), "n")
    )
