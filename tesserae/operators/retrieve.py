"""Search for any part of a text, whatever its case, over a stored index of three-letter pieces.

The index is a table of (gram, key) rows, partitioned by a hash of the gram: each row of the searched table has one for every
distinct piece of three characters of its lower-cased columns. A query is cut into its own pieces; only the partitions
of these are read, keys that have all of them are left, and their texts are verified, as pieces may stand apart. Queries of
fewer than three characters have no piece and are looked for in every text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import report

PARTS = 64


def grams(text: Column) -> Column:
    """The distinct pieces of three characters, in lower case; a look-ahead finds them at every place in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def part(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def build(df: DataFrame, key: str, columns: list[str], path: str, parts: int = PARTS) -> None:
    """Writes the index of a table. Columns are indexed apart, so that no piece reaches from one into the next."""
    rows = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col(c)) for c in columns))))).alias("gram"))
    rows = rows.withColumn("part", part(F.col("gram"), parts))
    rows.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(path)


def pieces(query: str) -> list[str]:
    low = query.lower()
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


def candidates(df: DataFrame, query: str, path: str, parts: int = PARTS) -> DataFrame:
    """(key) of the rows that have every piece of the query; reads the partitions of these pieces alone."""
    wanted = pieces(query)
    spark = df.sparkSession
    held = [r[0] for r in spark.range(1).select(F.explode(F.array(*(part(F.lit(g), parts) for g in wanted)))).distinct().collect()]
    index = spark.read.schema(f"key {df.schema['key'].dataType.simpleString()}, gram string, part int").parquet(path)
    rows = index.where(F.col("part").isin(held) & F.col("gram").isin(wanted))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("key")


def search(df: DataFrame, key: str, query: str, columns: list[str], path: str, parts: int = PARTS) -> DataFrame:
    """The rows of df in which a column holds the query, whatever its case; the index is that of build()."""
    if len(query) < 3:
        return report.search(df, query, *columns)
    found = candidates(df.select(F.col(key).alias("key")), query, path, parts)
    return report.search(df.join(found.withColumnRenamed("key", key), key, "left_semi"), query, *columns)


def everywhere(query: str, findings: DataFrame, folders: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(kind, name, text, total): the findings, folders and frameworks that hold the query, and how many there are in all.

    findings (category, description), folders (dir, purpose), frameworks (framework): reports, so that one window may count them.
    """
    from pyspark.sql import Window

    none = F.lit(None).cast("string")
    kinds = [
        report.search(findings, query, "category", "description").select(F.lit("finding").alias("kind"), F.col("category").alias("name"), F.col("description").alias("text")),
        report.search(folders.where("purpose IS NOT NULL"), query, "dir", "purpose").select(F.lit("folder"), "dir", "purpose"),
        report.search(frameworks, query, "framework").select(F.lit("framework"), "framework", none),
    ]
    return reduce(DataFrame.union, kinds).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
