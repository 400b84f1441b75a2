"""Companions of changed items, and what a set of changes leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import fan_in


def completeness(modified: DataFrame, partners: DataFrame, edges: DataFrame, tests: DataFrame, least_fan_in: int = 5) -> DataFrame:
    """(target, signal, confidence, cause): unmodified items that the modified(item, idx) ones usually bring along.

    partners(item, partner, strength), edges(src, dst), tests(item, test, pos). A target is warned of once, by the
    first modified item and then the first signal: co-change, import, test.
    """
    m = modified.select("item", "idx")
    strength = F.when(F.col("strength") >= 0.5, "high").when(F.col("strength") >= 0.3, "medium").otherwise("low")
    one = partners.join(m, "item").select(F.col("partner").alias("target"), "idx", F.lit(1).alias("sig"), F.lit("co-change").alias("signal"), strength.alias("confidence"), F.col("item").alias("cause"), (-F.col("strength")).alias("ord"))
    wide = fan_in(edges).where(F.col("importers") >= least_fan_in).select(F.col("node").alias("item"))
    two = edges.select(F.col("src").alias("target"), F.col("dst").alias("item")).distinct().join(wide, "item", "left_semi").join(m, "item")
    two = two.select("target", "idx", F.lit(2).alias("sig"), F.lit("import").alias("signal"), F.lit("medium").alias("confidence"), F.col("item").alias("cause"), F.lit(0.0).alias("ord"))
    three = tests.join(m, "item").select(F.col("test").alias("target"), "idx", F.lit(3).alias("sig"), F.lit("test").alias("signal"), F.lit("medium").alias("confidence"), F.col("item").alias("cause"), F.col("pos").cast("double").alias("ord"))
    found = reduce(DataFrame.unionByName, [one, two, three]).join(m.select(F.col("item").alias("target")), "target", "left_anti")
    first = F.row_number().over(Window.partitionBy("target").orderBy("idx", "sig", "ord", "cause"))
    return found.withColumn("r", first).where("r = 1").select("target", "signal", "confidence", "cause")


def companions(signals: DataFrame, least: float = 0.3, k: int = 5, cap: float = 1.0) -> DataFrame:
    """(item, companion, score, signals, rank) from signals(item, companion, stage, signal, points, gated).

    Points add up to the cap. A gated signal counts only where no earlier stage has scored the companion.
    """
    stage = F.min(F.when(~F.col("gated"), F.col("stage"))).over(Window.partitionBy("item", "companion"))
    first = F.min("stage").over(Window.partitionBy("item", "companion"))
    rows = signals.withColumn("open", F.least(F.coalesce(stage, F.lit(99)), first)).where(~F.col("gated") | (F.col("stage") == F.col("open")))
    scored = rows.groupBy("item", "companion").agg(
        F.round(F.least(F.sum("points"), F.lit(cap)), 6).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("stage", "signal"))), lambda s: s["signal"]), ",").alias("signals"),
    )
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "companion"))
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def accuracy(got: DataFrame, wanted: DataFrame, key: str, item: str) -> DataFrame:
    """(key, hits, recall, precision, f1) of the items found for each key; 4 decimals, 0 where undefined."""
    g, w = got.select(key, item).distinct(), wanted.select(key, item).distinct()
    both = g.withColumn("_got", F.lit(1)).join(w.withColumn("_wanted", F.lit(1)), [key, item], "full").groupBy(key)
    sums = both.agg(F.count("_got").alias("n_got"), F.count("_wanted").alias("n_wanted"), F.count_if(F.col("_got").isNotNull() & F.col("_wanted").isNotNull()).alias("hits"))
    part = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    return sums.select(key, "hits", part(F.col("hits"), F.col("n_wanted")).alias("recall"), part(F.col("hits"), F.col("n_got")).alias("precision"), part(2 * F.col("hits"), F.col("n_got") + F.col("n_wanted")).alias("f1"))
