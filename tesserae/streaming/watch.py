"""What a file watcher does, as Structured Streaming: bursts, change suppression and rate limits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import is_source_for_tasks
from ..sources.repository import IGNORED


def changes(spark: SparkSession, folder: str, schema: str, fmt: str = "json", names: str = "*") -> DataFrame:
    """The rows of files of such names as they arrive in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", names).load(folder)


def watched(events: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """The events (path) of source files that a watcher doesn't ignore: its own output least of all."""
    p = F.col("path")
    return events.where(is_source_for_tasks(p) & ~p.rlike(IGNORED) & ~p.isin(*own))


def bursts(stream: DataFrame, ts: str, key: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, n): events of a key with pauses under the gap; a burst is out once the watermark passes it."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fingerprint(rows: DataFrame, by: list[str], line: str) -> DataFrame:
    """(by, fingerprint): a digest of each group's lines, whatever their order."""
    return rows.groupBy(*by).agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("fingerprint"))


def when_changed(sink: Callable[[DataFrame, int], None], line: str, memory: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that passes a batch on only if its set of lines isn't that of the batch before.

    With a memory, a folder that is written by Spark, what was seen last outlives a restart.
    """
    seen: list[str] = []

    def recall(spark: SparkSession) -> list[str]:
        if memory is None or seen:
            return seen
        try:
            return [r[0] for r in spark.read.text(memory).collect()]  # one line
        except AnalysisException:  # nothing was seen before
            return []

    def each(batch: DataFrame, number: int) -> None:
        # A sum of hashes is free of order and of any gathering.
        now = str(tuple(batch.agg(F.count(F.lit(1)), F.sum(F.xxhash64(line).cast("decimal(20,0)"))).first()))
        if recall(batch.sparkSession) != [now]:
            sink(batch, number)
            seen[:] = [now]
            if memory is not None:
                batch.sparkSession.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(memory)

    return each


class Cache:
    """Results by key, kept for so many seconds: a scan that is asked for again soon isn't run again."""

    def __init__(self, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        at, df = self.held.get(key, (0.0, None))
        if df is None or refresh or self.clock() - at >= self.seconds:
            if df is not None:
                df.unpersist()
            df = build().persist()
            self.held[key] = (self.clock(), df)
        return df


def clock_limit(df: DataFrame, key: str, ts: str, tie: str, unit: str, most: int) -> DataFrame:
    """(key, allowed, rejected): requests beyond so many in one clock unit are rejected."""
    k = F.row_number().over(Window.partitionBy(key, F.date_trunc(unit, ts)).orderBy(ts, tie))
    return df.withColumn("k", k).groupBy(key).agg(F.count_if(F.col("k") <= most).alias("allowed"), F.count_if(F.col("k") > most).alias("rejected"))


def rate_limit(stream: DataFrame, key: str, ts: str, seconds: float = 60, most: int = 10) -> DataFrame:
    """(key, ts, allowed) for each event: a key's window opens at its first request and lasts so many seconds.

    A key that is silent for longer than a window is forgotten, so that state doesn't grow with all keys ever seen.
    """

    def judge(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        for frame in frames:
            out = []
            for t in frame[ts].sort_values():
                at = t.timestamp()
                if opened is None or at - opened >= seconds:
                    opened, n = at, 0
                n += 1
                out.append((name[0], t, n <= most))
            yield pd.DataFrame(out, columns=["key", "ts", "allowed"])
        state.update((opened, n))
        state.setTimeoutDuration(int(seconds * 1000))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(judge, f"key {kind}, ts timestamp, allowed boolean", "opened double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
