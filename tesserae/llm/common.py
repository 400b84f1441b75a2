"""Helpers that the training-data operators share: shared storage, components, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder; in local mode (as in tests) a new one if neither is set."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if name is None:
        name = spark.sparkContext.getCheckpointDir()
    if name is None and spark.sparkContext.master.split("[")[0] == "local":
        name = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    if name is None:
        raise ValueError("set spark.checkpoint.dir (or the context's checkpoint folder) to a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(name)
    return name


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """df written to, and reread from, a Parquet table of its own in the shared folder.

    Bucketed by a column, it is joined on that column without being shuffled again; such a table has a name in the
    catalog, which finished() drops once the results that read it are cut. The files stay until the folder is cleared.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark).rstrip('/')}/tesserae/{name}"
    if by is not None:
        buckets = buckets or partitions(spark)
        df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(f"tesserae_{name}")
        out = spark.table(f"tesserae_{name}")
        out.stored_as, out.stored_in = f"tesserae_{name}", buckets
        return out
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """The result, cut, with the catalog's names of the tables it was made from dropped."""
    result = cut(result)
    for table in tables:
        result.sparkSession.sql(f"DROP TABLE {table.stored_as}")
    return result


def prefix_for(df: DataFrame) -> str:
    """A prefix that no column of df starts with."""
    out = "_"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Each Arrow batch with the UTF-8 bytes of its text column."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        yield batch, column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b), root being the smallest node that it reaches.

    Every round hooks each node to its smallest neighbour and contracts the graph to the hooks. Give node ids
    that are hashes: in a random order the edges shrink geometrically whatever the graph's shape. No
    neighbourhood is ever gathered: minima are pre-aggregated, and AQE can split the joins by a hot node.
    Labels are checkpointed each round. Without edges: no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
        hops.append(hook)
        x, y = (hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = edges.join(x, "a").join(y, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        # What a node hooked to may itself have hooked on: that link has to stay.
        chain = hook.select(F.col("root").alias("b")).distinct().join(y, "b").select(F.col("rb").alias("a"), "b")
        edges = cut(moved.unionByName(chain).where("a <> b").distinct())
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hops[0]
    for hook in hops[1:]:
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("to"))
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(out)
