"""Running sums and row numbers over a whole table without a window over all of it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, set for its context; in local mode a new one if it names none."""
    context = spark.sparkContext
    name = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if name is None and context.master.split("[")[0] == "local":
        name = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    if name is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(name)
    return name


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows that come before in the order, which has to be total.

    Rows are range-sorted and cut; each partition is summed by itself, and the driver adds up a number for each.
    """
    rows = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    own = sorted(rows.groupBy("_part").agg(F.sum(value)).collect())  # a row for each partition
    before, base = 0, {}
    for part, total in own:
        base[part], before = before, before + (total or 0)
    start = F.element_at(F.create_map(*(F.lit(x) for p in base.items() for x in p)), F.col("_part")) if base else F.lit(0)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)) + start).drop("_part")
