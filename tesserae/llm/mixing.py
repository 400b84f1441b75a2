"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Source k (by code point, null last) weighs weights[k mod n] and takes that share of all words, but at most `cap`
times its own; what is over is reshared by weight among the rest until none is above. Over training time t in
[0, 1] a source's weight runs as 1 + slope * (2t - 1); its integral t + slope * (t*t - t) is the share of the
source's demand that is due by t, and the inverse of that integral gives a document, which stands at some share of
its source's words, its training position. Documents are range-sorted by position.

Running sums over a source don't gather it: words are summed per source and cell (the first digits of the md5 of the
id, as many as keep a cell of all rows near CELL_ROWS), the cell sums are accumulated, and only the rows of one cell
meet in a task. The order is that of the md5, so the number of cells changes no result.

Units: "words" takes floor differences of the running demand, so a source's taken words are its target but for
rounding (the last pass over a document may be a part of it); "documents" takes whole documents, copies of each by
floor differences over the source's documents in order of size.

Defined cases: a null text has size 0 and takes nothing; a source without words has target 0; null sources are a
source of their own; null ids sort first; repeated rows are documents of their own in "words" and share one copy
count in "documents"; an empty table gives no rows; columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, CAP, SLOPES, CELL_ROWS = (5, 2, 1), 3, (0.5, 0.0, -0.5), 20_000


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) of each source of rows (source, size)."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("turn", turn)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1)
    slope = F.element_at(F.array(*(F.lit(float(x)) for x in slopes)), F.col("turn") % len(slopes) + 1)
    by = common.cut(by.select("source", "source_size", weight.alias("weight"), slope.alias("slope")))
    all_words = by.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rate, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(rate) > cap * F.col("source_size") if capped >= 0 else F.lit(False)
        n, held, rest = by.agg(F.count_if(over), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == capped:
            break
        capped, rate = n, (all_words - (held or 0)) / rest if rest else rate
    limit = (cap * F.col("source_size")).cast("double")
    return by.select("source", "source_size", F.when(F.col("weight") * F.lit(rate) > limit, limit).otherwise(F.col("weight") * F.lit(rate)).alias("target"), "slope")


def running(rows: DataFrame, cell: Column, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same source that come before, by cell and then by order."""
    rows = rows.withColumn("cell", cell)
    sums = rows.groupBy("source", "cell").agg(F.sum(value).alias("own"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    return rows.withColumn(name, F.col("base") + F.col("inner")).drop("s", "c", "cell", "base", "inner")


def position(share: Column, slope: Column) -> Column:
    """The time in [0, 1] by which that share of a source's demand is due."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def order_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, unit: str = "words", weights: Sequence[int] = WEIGHTS, cap: int = CAP, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies, position) of each row of docs, sorted by position."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = common.cut(rows)
    digits = max(3, math.ceil(math.log(max(1, rows.count() / CELL_ROWS), 16)))
    by = targets(rows, weights, cap, slopes)
    rows = rows.withColumn("key", order_key())
    rows = running(rows, F.substring("key", 1, digits), [F.col("key"), F.col("size")], F.col("size"), "before")
    by = by.withColumnRenamed("source", "s").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rate = F.col("rate")
    if unit == "documents":
        # Cells by size, falling, in steps of an eighth of a power of two, then by key: neighbours are of like size.
        step = F.lpad(F.lit(999) - F.floor(F.log2(F.col("size") + 1) * 8), 3, "0")
        rows = running(rows, F.concat(step, F.substring("key", 1, digits - 1)), [F.col("key"), F.col("size")], F.lit(1), "index")
        at = F.col("index")
        copies = (F.floor(rate * (at + 1) + 0.5) - F.floor(rate * at + 0.5)).cast("long")  # centred: no bias to the small
        taken = copies * F.col("size")
    else:
        end = F.col("before") + F.col("size")
        taken = (F.floor(rate * end) - F.floor(rate * F.col("before"))).cast("long")
        copies = F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(0).cast("long")
    share = F.when(F.col("source_size") > 0, (F.col("before") + F.col("size") / 2) / F.col("source_size")).otherwise(0.0)
    rows = rows.join(F.broadcast(by) if by.count() <= 10_000 else by, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), copies.alias("copies"), F.round(position(share, F.col("slope")), 9).alias("position")).orderBy("position", "doc_id")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by training position.

    The passes over a document that is taken more than once follow each other as epochs of its source.
    """
    got = mix(docs, "documents", weights, cap, slopes).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"), F.min("position").alias("position"))
    x = common.prefix_for(docs)
    got = got.select(*(F.col(c).alias(x + c) for c in got.columns))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(x + "doc_id")) & F.col("source").cast("string").eqNullSafe(F.col(x + "source")) & (size == F.col(x + "size"))
    rows = docs.join(got, same).withColumn(x + "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col(x + "copies") - 1)))
    rows = rows.withColumn(x + "at", (F.col(x + "pass") + F.col(x + "position")) / F.col(x + "copies"))
    return rows.repartitionByRange(x + "at", "doc_id").sortWithinPartitions(x + "at", "doc_id").select(*docs.columns)


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{common.WORD}')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             CASE turn WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM s),
-- Sources reach their caps in order of size over weight: the first k that do are capped.
o AS (SELECT *, row_number() OVER q AS k, sum(source_size) OVER () AS words,
             sum(3 * source_size) OVER q AS held, sum(weight) OVER () - sum(weight) OVER q AS rest FROM w
      WINDOW q AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
r AS (SELECT 0 AS k, any_value(words)::DOUBLE / sum(weight) AS rate FROM o
      UNION ALL SELECT k, (words - held)::DOUBLE / rest FROM o WHERE rest > 0),
f AS (SELECT rate FROM r ORDER BY rate DESC LIMIT 1),
t AS (SELECT source, source_size, slope, least(3 * source_size, weight * rate)::DOUBLE AS target FROM w, f),
c AS (SELECT d.*, source_size, slope, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, CAST(floor(rate * (before + size)) - floor(rate * before) AS BIGINT) AS taken,
             CASE WHEN source_size > 0 THEN (before + size / 2::DOUBLE) / source_size ELSE 0 END AS share FROM c)
SELECT doc_id, size, source, source_size, target, taken,
       CASE WHEN size > 0 THEN CAST(ceil(taken / size::DOUBLE) AS BIGINT) ELSE 0 END AS copies,
       round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 9) AS position
FROM g
"""
