"""A scan that is kept up to date: each file's facts live in keyed state, and only what changes is told.

Versions of files (path, content, removed) stream in. What the rules see in a version (imports and patterns) is worked out by
column expressions; the state of a path holds what its last version showed. A version that shows the same tells nothing; else
the facts that came and went are told as (path, kind, value, change), change being 1 or -1. Summed up, the changes are the
facts of the tree as it is, so that a scan after a change costs the changed files alone.

State is kept in the checkpoint, so a restart goes on where the stream ended. With a time to live, a path that nothing was
heard of for so long is forgotten: its next version is told in full, with a `since` of its own, which newest() prefers.
The state store has to be RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampType

from ..operators import extract, patterns

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "path string, kind string, value string, change int, since timestamp"
STATE = StructType([StructField("facts", ArrayType(StringType())), StructField("since", TimestampType())])
SEPARATOR = "\x1f"
IMPORTS = {r"\.(tsx?|jsx?)$": extract.script_imports, r"\.py$": extract.python_imports, r"\.go$": extract.go_imports, r"\.rs$": extract.rust_imports}


def facts(versions: DataFrame) -> DataFrame:
    """versions (path, content, ...) with what they show as facts: imports by specifier, patterns by family and name, as strings of kind and value."""
    p = F.col("path")
    none = F.array().cast("array<string>")
    fact = lambda kind, *value: F.concat(F.lit(kind + SEPARATOR), *value)
    specs = [F.when(p.rlike(pattern), F.transform(found(F.coalesce("content", F.lit(""))), lambda s: fact("import", s))).otherwise(none) for pattern, found in IMPORTS.items()]
    rows = versions.withColumns({"_specs": F.concat(*specs), "_body": patterns.body(p, F.col("content"))}).drop("content")
    shown = F.transform(patterns.shown(p, F.col("_body")), lambda v: fact("pattern", v["family"], F.lit("/"), v["name"]))
    return rows.withColumn("facts", F.array_sort(F.array_distinct(F.concat("_specs", shown)))).drop("_specs", "_body")


class Remembered(StatefulProcessor):
    """The facts of one path; a version's differences from them are told."""

    def __init__(self, seconds: int | None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = {} if self.seconds is None else {"ttlDurationMs": self.seconds * 1000}
        self.state = handle.getValueState("facts", STATE, **life)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        versions = pd.concat(list(rows), ignore_index=True).sort_values("version", kind="stable")
        last = versions.iloc[-1]  # of versions in one batch the newest counts
        known = self.state.get() if self.state.exists() else None
        before, since = (list(known[0]), known[1]) if known else ([], last["version"].to_pydatetime())
        now = [] if last["removed"] else list(last["facts"])
        told = [(x, 1) for x in now if x not in set(before)] + [(x, -1) for x in before if x not in set(now)]
        if last["removed"]:
            self.state.clear()
        elif told or known is None or self.seconds is not None:
            self.state.update((now, since))  # heard of: the time to live begins again
        if told:
            split = [x.split(SEPARATOR, 1) for x, _ in told]
            yield pd.DataFrame({"path": key[0], "kind": [k for k, _ in split], "value": [v for _, v in split], "change": [c for _, c in told], "since": since})

    def close(self) -> None:
        pass


def changed_facts(versions: DataFrame, seconds: int | None = None) -> DataFrame:
    """CHANGES of a stream of versions (path, content, removed, version): what came (1) and went (-1) since the last one of a path.

    version is a timestamp that orders the versions of a path. Ignored files should be left out first: watch.watched().
    """
    rows = versions.where("path IS NOT NULL").select("path", F.col("version").cast("timestamp").alias("version"), F.coalesce("removed", F.lit(False)).alias("removed"), "content")
    mode = "None" if seconds is None else "ProcessingTime"
    return facts(rows).groupBy("path").transformWithStateInPandas(Remembered(seconds), CHANGES, "Append", mode)


def newest(changes: DataFrame) -> DataFrame:
    """(path, kind, value) that holds now, by the changes told so far; a path that was forgotten counts from where it was told in full again."""
    last = F.max("since").over(Window.partitionBy("path"))
    rows = changes.withColumn("last", last).where(F.col("since") == F.col("last"))
    return rows.groupBy("path", "kind", "value").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


def votes(now: DataFrame) -> DataFrame:
    """(family, name, n) of the patterns that hold now, as patterns.tally() counts them."""
    rows = now.where("kind = 'pattern'").select(F.split_part("value", F.lit("/"), F.lit(1)).alias("family"), F.regexp_replace("value", "^[^/]*/", "").alias("name"))
    return rows.groupBy("family", "name").agg(F.count(F.lit(1)).alias("n"))


def keep(spark: SparkSession, versions: DataFrame, table: str, checkpoint: str, seconds: int | None = None):
    """A query that appends the changes to a Parquet folder; started anew with its checkpoint, it goes on where it ended.

    It takes what has arrived and ends. With a time to live, batches without data are left out, as they would never end.
    """
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        return changed_facts(versions, seconds).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
