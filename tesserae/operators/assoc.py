"""Association mining: pairs of items that occur in the same transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cooccur(df: DataFrame, txn: list[str], item: str, min_items: int = 2, max_items: int = 20, min_count: int = 2, min_strength: float = 0.2, group: Column | None = None) -> DataFrame:
    """(a, b, cnt, strength) for a < b: strength is the Jaccard coefficient of their transactions.

    Transactions with fewer than min_items or more than max_items distinct items are left out before anything is
    counted, which bounds the pairs of a transaction. With group (over a column `item`), only pairs across groups.
    """
    base = df.select(*(F.col(c).alias(f"t{k}") for k, c in enumerate(txn)), F.col(item).alias("item")).dropna().distinct()
    keys = [f"t{k}" for k in range(len(txn))]
    # Sizes come from pre-aggregated counts, so only transactions of max_items at most are gathered and paired in place.
    fit = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(min_items, max_items)).drop("n")
    baskets = base.join(fit, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    totals = baskets.select(F.explode("items").alias("item")).groupBy("item").count()
    tails = F.transform("items", lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = baskets.select(F.explode(F.flatten(tails)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count)
    x, y = (totals.select(F.col("item").alias(c), F.col("count").alias(f"n{c}")) for c in "ab")
    out = pairs.join(x, "a").join(y, "b").withColumn("strength", F.col("cnt") / (F.col("na") + F.col("nb") - F.col("cnt")))
    if group is not None:
        sides = [out.select(F.col(c).alias("item"), c).distinct().select(c, group.alias(f"g{c}")) for c in "ab"]
        out = out.join(sides[0], "a").join(sides[1], "b").where("ga <> gb")
    return out.where(F.col("strength") > min_strength).select("a", "b", "cnt", F.round("strength", 6).alias("strength"))


def partners(pairs: DataFrame) -> DataFrame:
    """(item, partner, cnt, strength): every pair from both sides, so that lookups are equality joins."""
    return pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "cnt", "strength").unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "cnt", "strength"))


def strongest(pairs: DataFrame) -> DataFrame:
    """Each item's strongest partner; ties go to the smaller name."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("strength"), "partner"))
    return partners(pairs).withColumn("rank", rank).where("rank = 1").drop("rank")
