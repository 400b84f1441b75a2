"""Reports: sections under a token budget, merges and differences of texts, retrieval and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import windows


def budget(sections: DataFrame, limit: int, keep: int = 90) -> DataFrame:
    """sections(pos, priority, tokens) that fit: the least important are dropped while the total is over the limit.

    Sections of priority keep and above stay. Reports are small, so their running sum is one window.
    """
    order = Window.orderBy("priority", "pos").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("tokens").over(Window.partitionBy())
    rows = sections.withColumn("over", total - F.coalesce(F.sum("tokens").over(order), F.lit(0)) > limit)
    return rows.where(~F.col("over") | (F.col("priority") >= keep)).drop("over")


def budget_by_priority(sections: DataFrame, limit: int, keep: int = 90) -> DataFrame:
    """As budget(), for sections in any number: running sums by ranges of the order, no window over all of them."""
    rows = windows.running(sections, ["priority", "pos"], F.col("tokens"), "before")
    total = sections.agg(F.sum("tokens")).first()[0] or 0
    return rows.where((F.lit(total) - F.col("before") <= limit) | (F.col("priority") >= keep)).drop("before")


def sections(df: DataFrame, key: str, text: str, header: str = r"## ") -> DataFrame:
    """(key, pos, header, body): what stands under each header line; before the first one the header is empty."""
    parts = df.select(key, F.posexplode(F.split(text, r"(?m)^" + header)).alias("pos", "part"))
    head, body = F.when(F.col("pos") == 0, "").otherwise(F.regexp_extract("part", r"^([^\n]*)", 1)), F.when(F.col("pos") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return parts.select(key, "pos", F.trim(head).alias("header"), F.trim(body).alias("body")).where("pos > 0 OR body <> ''")


def manual(sections: DataFrame, known: Sequence[str] = fixed.OWN_HEADERS) -> DataFrame:
    """The sections (header) that were written by hand."""
    return sections.where((F.col("header") != "") & ~F.col("header").isin(*known))


def merge(generated: DataFrame, existing: DataFrame, known: Sequence[str] = fixed.OWN_HEADERS, marker: str = fixed.MARKER) -> DataFrame:
    """(header, body, ord): the generated sections with those of existing that nobody generates, before the marker or at the end."""
    own = manual(existing, known).join(generated.select("header"), "header", "left_anti")
    at = generated.agg(F.coalesce(F.min(F.when(F.col("header") == marker, F.col("pos"))), F.max("pos") + 1, F.lit(0)).alias("at"))
    own = own.crossJoin(F.broadcast(at)).select("header", "body", (F.col("at") - 0.5 + F.col("pos") * 1e-6).alias("ord"))  # one row
    return generated.select("header", "body", F.col("pos").cast("double").alias("ord")).unionByName(own)


def new_lines(new: DataFrame, old: DataFrame, text: str) -> DataFrame:
    """(line, n): trimmed non-empty lines of new that old hasn't, with their counts (a bag difference)."""
    lines = lambda df: df.select(F.explode(F.split(text, "\n")).alias("l")).select(F.trim("l").alias("line")).where("line <> ''")
    return lines(new).groupBy("line").agg(F.count(F.lit(1)).alias("n")).join(lines(old).distinct(), "line", "left_anti")


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """The rows in which a column holds the query, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return df.where(hit)


def topics(df: DataFrame, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """df with, exploded, each topic that it touches: two points for a keyword as a word, one within a word."""

    def points(words: list[str]) -> Column:
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        return sum((F.when(low.rlike(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"), 2).when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))

    rows = df.withColumn("t", F.explode(F.array(*(F.struct(F.lit(n).alias("topic"), points(w).alias("points")) for n, w in keywords.items()))))
    return rows.select(*df.columns, "t.topic", "t.points").where("points > 0")


def run_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("sd"),
        F.round(F.min(value), 4).alias("low"),
        F.round(F.max(value), 4).alias("high"),
    )


def ci95(mean_sd_n: DataFrame) -> DataFrame:
    """With half_width, the half width of the 95 % interval of the mean; t values for few runs, else 1.96."""
    # Two-sided 95 % t quantiles by number of runs.
    t = F.when(F.col("n") == 2, 12.706).when(F.col("n") == 3, 4.303).when(F.col("n") == 4, 3.182).when(F.col("n") == 5, 2.776).when(F.col("n") == 6, 2.571).otherwise(1.96)
    return mean_sd_n.withColumn("half_width", F.when(F.col("n") < 2, 0.0).otherwise(F.round(t * F.col("sd") / F.sqrt("n"), 4)))


def wins(means: DataFrame, key: str, side: str, value: str, a: str, b: str, tie: float = 0.01) -> DataFrame:
    """(wins, ties, losses) of side a against side b over the keys that have both; within the tie margin it's a tie."""
    x = means.where(F.col(side) == a).select(key, F.col(value).alias("x"))
    y = means.where(F.col(side) == b).select(key, F.col(value).alias("y"))
    d = F.col("x") - F.col("y")
    return x.join(y, key).agg(F.count_if(d > tie).alias("wins"), F.count_if(F.abs(d) <= tie).alias("ties"), F.count_if(d < -tie).alias("losses"))


def divergence(means: DataFrame, key: str, value: str, least: float = 0.01) -> DataFrame:
    """(key, spread): how far the means of a key lie apart, where that is more than least before it is rounded.

    Four digits are rounded as DuckDB does, by the product: F.round goes by the shortest decimal, and ties may fall apart.
    """
    apart = means.groupBy(key).agg((F.max(value) - F.min(value)).alias("spread")).where(F.col("spread") > least)
    return apart.withColumn("spread", F.round(F.col("spread") * 10_000) / 10_000)
