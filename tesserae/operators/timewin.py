"""Activity in time windows. Windows end at the newest row of the table, so results don't depend on today."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(df: DataFrame, ts: str, days: int) -> Column | None:
    """The midnight after which the last so many days of the table begin, as a literal of the column's type; none for no rows."""
    newest = df.agg(F.max(F.to_date(ts))).first()[0]
    if newest is None:
        return None
    return F.lit((newest - timedelta(days=days - 1)).isoformat()).cast(df.schema[ts].dataType)


def recent(df: DataFrame, ts: str, days: int) -> DataFrame:
    """The rows of the last so many days of the table. The bound is a literal, so it reaches the scan."""
    start = since(df, ts, days)
    return df.where(F.lit(False)) if start is None else df.where(F.col(ts) >= start)


def newest(df: DataFrame, n: int, key: str = "commit_id", ts: str = "ts", parts: list[str] | None = None) -> DataFrame:
    """The rows of the n newest keys (ties by key). These are found first, in a scan of two columns, and broadcast: n rows at most.

    parts are columns that the table is partitioned by: named in the join, they prune the partitions that hold none of the keys
    when the query runs, so that old history isn't read (Spark does so where a bound, such as that of recent(), is given).
    """
    on = [*(parts or []), ts, key]
    keys = df.select(*on).where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct().orderBy(F.desc(ts), key).limit(n)
    return df.join(F.broadcast(keys), on, "left_semi")


def top_counts(df: DataFrame, key: str, k: int, least: int = 1) -> DataFrame:
    """(key, n) of the k most frequent values; ties by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(k)


def rapid_edits(df: DataFrame, key: str, ts: str, days: int = 7, least: int = 5) -> DataFrame:
    """(key, start, n): the first day from which least or more rows fall within so many days, ends included."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    rows = df.select(key, F.to_date(ts).alias("start"), day.alias("day"))
    ahead = Window.partitionBy(key).orderBy("day").rangeBetween(0, days)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(ahead)).where(F.col("n") >= least)
    first = F.row_number().over(Window.partitionBy(key).orderBy("day", F.desc("n")))
    return rows.withColumn("r", first).where("r = 1").select(key, "start", "n")


def share(df: DataFrame, condition: Column) -> DataFrame:
    """(total, matching, share) of the rows for which a condition holds."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(condition).alias("matching"), F.round(F.avg(condition.cast("double")), 6).alias("share"))


def batches(df: DataFrame, key: str, ts: str, least: int, k: int) -> DataFrame:
    """(key, n, ts) of the k newest groups of least or more rows, then one row that counts the others."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("ts")).where(F.col("n") >= least)
    top = groups.orderBy(F.desc("ts"), key).limit(k).select(F.col(key).cast("string").alias("label"), "n")
    rest = groups.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("n")).select(F.lit("others").alias("label"), "n").where("n > 0")
    return top.unionByName(rest)


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, n): bursts of rows with pauses shorter than the gap."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")
