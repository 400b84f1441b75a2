"""Pattern votes: which pattern of a family do most texts show, and how sure is that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows


def tally(texts: DataFrame, text: str, patterns: list[tuple[str, str, str]], by: list[str] | None = None) -> DataFrame:
    """(by, family, name, n): how many texts match each (family, name, regex), all in one scan."""
    by = by or []
    flags = [F.count_if(F.coalesce(F.col(text), F.lit("")).rlike(regex)).alias(f"c{k}") for k, (_, _, regex) in enumerate(patterns)]
    wide = texts.groupBy(*by).agg(*flags)
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(n).alias("name"), F.col(f"c{k}").alias("n")) for k, (f, n, _) in enumerate(patterns))))
    return wide.select(*by, long.alias("v")).select(*by, "v.*")


def dominant(counts: DataFrame, least: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """The most frequent pattern of each family that reaches the family's threshold; ties go to the smaller name."""
    by = by or []
    needed = F.element_at(F.create_map(*(F.lit(x) for pair in least.items() for x in pair)), F.col("family"))
    rank = F.row_number().over(Window.partitionBy(*by, "family").orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("n") >= F.coalesce(needed, F.lit(1)))).drop("rank")


def evidence(df: DataFrame, count: Column, overlap: Column, active: Column, tiers: tuple[int, int, int] = (3, 5, 7)) -> DataFrame:
    """df with points and confidence: a tier for how many files, two or one for ranked ones, one for an active area."""
    tier = F.when(count >= tiers[2], 3).when(count >= tiers[1], 2).when(count >= tiers[0], 1).otherwise(0)
    ranked = F.when(overlap >= 2, 2).when(overlap == 1, 1).otherwise(0)
    df = df.withColumn("points", tier + ranked + active.cast("int"))
    return df.withColumn("confidence", F.when(F.col("points") >= 3, "high").when(F.col("points") == 2, "medium").otherwise("low"))


def confidence_order(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def stride(df: DataFrame, key: str, slots: int) -> DataFrame:
    """Every n-th distinct key, so many at most."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    rows = windows.running(keys, [key], F.lit(1), "i")
    step = max(1, rows.count() // slots)
    return rows.where(F.col("i") % step == 0).orderBy("i").limit(slots).select(key)
