"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

A component's index is a term. Candidates are dealt into blocks of about `rows` vectors and inverted there: a term's
posting list holds the vectors in which it isn't zero, with their weights. A query is the sparse list of its own
terms; each scatters query weight times posting weight into the block's dense score array. The k best of a block
come from a partition selection, and the blocks' winners are merged by rank. A task holds one candidate block, each of
which is moved once, and streams the query blocks of about `queries` rows, the smaller side, past it.

Weights are floor(scale * x), x as double, and scores are integers, so results don't depend on the order of sums
(scores have to fit in a long). Vectors of unlike lengths are compared as if padded with zeros.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
empty vectors score 0 with all; ties go to the smaller id; of rows that share a query's id, the one with the least
vector asks (the lists compared element by element) and is left out itself, while the others are candidates like any
and each take a rank; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, SCALE, ROWS, QUERIES, AT_ONCE = 10, 1024, 4096, 1024, 64
SCHEMA = "query_id long, vec_id long, score long"


def weights(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, w, row) of the rows that take part; row numbers them."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & good)
    w = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), w.alias("w"), F.monotonically_increasing_id().alias("row"))


Block = tuple[np.ndarray, np.ndarray, list[np.ndarray]]  # ids, row numbers and vectors


def inverted(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The posting list of each term: which vectors have it, and their weights."""
    terms = np.concatenate([np.arange(len(v)) for v in vectors]) if vectors else np.empty(0, np.int64)
    held = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    w = np.concatenate(vectors) if vectors else np.empty(0, np.int64)
    terms, held, w = (x[w != 0] for x in (terms, held, w))
    order = np.argsort(terms, kind="stable")
    terms, held, w = terms[order], held[order], w[order]
    ends = np.searchsorted(terms, np.arange(int(terms[-1]) + 2 if len(terms) else 1))
    return [(held[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def block_top(queries: Block, ids: np.ndarray, rows: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[int], list[int], list[int]]:
    """The k best of one block for each query."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for at in range(0, len(queries[0]), AT_ONCE):
        asked = queries[2][at : at + AT_ONCE]
        q = np.zeros((len(asked), len(postings)), np.int64)
        for i, v in enumerate(asked):
            q[i, : len(v)] = v[: len(postings)]
        scores = np.zeros((len(asked), len(ids)), np.int64)
        for t, (where, by) in enumerate(postings):
            on = np.flatnonzero(q[:, t])
            if len(where) == len(ids) and len(on) == len(asked):
                scores += q[:, t, None] * by
            else:
                scores[np.ix_(on, where)] += q[on, t, None] * by
        for own, qid, row in zip(scores, queries[0][at : at + AT_ONCE].tolist(), queries[1][at : at + AT_ONCE].tolist(), strict=True):
            other = np.flatnonzero(rows != row)
            if len(other) > k:
                these = own[other]
                other = other[these >= np.partition(these, len(these) - k)[len(these) - k]]
            best = other[np.lexsort((ids[other], -own[other]))][:k]
            out[0].extend([qid] * len(best))
            out[1].extend(ids[best].tolist())
            out[2].extend(own[best].tolist())
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row where is_query (of vec_id) holds."""
    w = common.cut(weights(vectors, scale))
    asked = w.where(is_query).groupBy("vec_id").agg(F.min(F.struct("w", "row")).alias("r")).select("vec_id", "r.*")
    n, n_asked = w.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // rows)), max(1, -(-n_asked // queries))

    def blocks(df: DataFrame, count: int, name: str) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("vec_id", "row"), F.lit(count)).cast("int").alias(name)).agg(F.collect_list(F.struct("vec_id", "row", "w")).alias("held"))

    every = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c")
    left = blocks(asked, q_blocks, "q").select(every, F.col("q").alias("side"), "held")
    right = blocks(w, c_blocks, "c").select("c", F.lit(-1).alias("side"), "held")

    def read(held: pa.StructArray) -> Block:
        lists = held.field("w")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        ids, numbers = (held.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
        return ids, numbers, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mine = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                c, held = batch.column(0)[r].as_py(), read(batch.column(2)[r].values)
                if batch.column(1)[r].as_py() < 0:
                    block, mine = c, (held[0], held[1], inverted(held[2]))
                elif block == c:
                    found = block_top(held, *mine, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    sides = left.unionByName(right).repartition(max(1, min(c_blocks, 20_000)), "c").sortWithinPartitions("c", "side")
    best = sides.mapInArrow(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH w AS (SELECT vec_id, [CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
r AS (SELECT *, row_number() OVER () AS row FROM w),
q AS (SELECT * FROM r WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v, row) = 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM q JOIN r c ON q.row <> c.row)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
