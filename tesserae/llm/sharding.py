"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups that hold at least 1/(shards * GRAIN) of all bytes are few (shards * GRAIN at most, whatever the input); they
are packed first, on the driver. The other groups are dealt into cells by hash, and each cell packs its own into
its share of what room the shards have left, in a task of its own. Groups sorted by size enter the bin whose
remaining capacity is the tightest that holds them, found in a balanced tree. Bins of equal capacity come in another
order in each cell, so that rounding doesn't add up.

With a number of shards, a group that fits nowhere enters the emptiest bin, and one larger than a shard's share stays
whole; the other shards then share the rest equally. With a capacity no shard goes over it, but for a group that is
larger by itself: what fits nowhere opens a new bin among the big groups; cells leave it over, and what all have left
over is packed again into the room that remains; where a round leaves more than half of its groups, bins are opened
for them. A light group is smaller than 1/GRAIN of a shard: that is what each cell can leave free in a bin.

Slots number a shard's rows without gathering it: rows are counted by shard and cell, and the counts accumulated.

Defined cases: a null text has no bytes (size 1) and is grouped with the empty text; null ids sort first; repeated
rows are in one group and get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS, GRAIN, CELL_GROUPS, CELL_ROWS, UNIT = 8, 2048, 500, 2000, 64


class Capacities:
    """Bins by remaining capacity in a treap: a search tree that random priorities keep balanced."""

    def __init__(self, bins: Iterable[tuple[int, int]]):
        self.random, self.root = random.Random(7), None
        for room, name in bins:
            self.add(room, name)

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(low, [(room, name), self.random.random(), None, None]), high)

    def take(self, size: int, strict: bool = False) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of at least size, or else the one with the most room (strict: none)."""
        low, high = self._split(self.root, (size, -1))
        if high is None and (strict or low is None):
            self.root = low
            return None
        if high is None:
            low, (best, *_) = self._cut(low, last=True)
        else:
            high, (best, *_) = self._cut(high, last=False)
        self.root = self._merge(low, high)
        return best

    def _split(self, node, key):
        """Two trees: keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def _cut(self, node, last: bool):
        """The tree without its last (or first) node, and that node."""
        side, other = (3, 2) if last else (2, 3)
        if node[side] is None:
            return node[other], node
        node[side], found = self._cut(node[side], last)
        return node, found


def best_fit(sizes: Iterable[int], room: list[int], turn: int = 0, strict: bool = False, capacity: int | None = None) -> list[int]:
    """The bin of each size, given in falling order; room is reduced in place.

    Strict: -1 for what fits nowhere, or, with a capacity, a new bin that is appended to room.
    """
    n = len(room)
    tree, out = Capacities((r, (k - turn) % n) for k, r in enumerate(room)), []
    for size in sizes:
        found = tree.take(size, strict)
        if found is None and capacity is None:
            out.append(-1)
            continue
        if found is None:
            room.append(capacity - size)
            tree.add(max(0, capacity - size), len(room) - 1)
            out.append(len(room) - 1)
            continue
        left, name = found
        tree.add(left - size, name)
        k = (name + turn) % n if name < n else name
        room[k] -= size
        out.append(k)
    return out


def fill(light: DataFrame, room: list[int], turn: int = 0, strict: bool = False) -> DataFrame:
    """light (digest, bytes) with the shard of each group: a cell packs its own into its share of the room; -1 if left over.

    Strict: units of about UNIT bins each have their own cells, so that a cell's share of a bin holds some groups.
    """
    n, held = light.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    bins = len(room)
    units = max(1, bins // UNIT) if strict else 1
    each = max(1, -(-n // (CELL_GROUPS * units)))
    shares = [x / sum(room) if sum(room) else 1 / bins for x in room]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True])
        cell, own = int(pdf["cell"].iloc[0]), int(pdf["bytes"].sum())
        mine = range(cell % units, bins, units)
        part = [int(room[k] * min(1.0, own * units / held) if strict else shares[k] * own) for k in mine]
        got = best_fit(pdf["bytes"].tolist(), part, cell % len(mine), strict)
        return pd.DataFrame({"digest": pdf["digest"], "bytes": pdf["bytes"], "shard": [k if k < 0 else mine[k] for k in got]})

    light = light.withColumn("cell", F.pmod(F.xxhash64("digest", F.lit(turn)), F.lit(units * each)))
    return light.groupBy("cell").applyInPandas(pack, "digest binary, bytes long, shard int")


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    Give the number of shards, or a capacity in bytes, of which as few shards as can hold all are then made.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = common.cut(rows)
    groups = common.cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total, n_groups, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    count = shards if capacity is None else max(1, -(-total // capacity))
    room = [-(-total // count) if capacity is None else capacity] * count
    is_heavy = F.col("bytes") * F.lit(count * GRAIN) >= total
    heavy = groups.where(is_heavy).orderBy(F.desc("bytes"), "digest").select("digest", "bytes").collect()
    found = best_fit((b for _, b in heavy), room, 0, capacity is not None, capacity)
    placed = spark.createDataFrame([(bytearray(d), k) for (d, _), k in zip(heavy, found, strict=True)], "digest binary, shard int")
    left, n_left = groups.where(~is_heavy).select("digest", "bytes"), n_groups - len(heavy)
    turn = 0
    while n_left:
        got = common.cut(fill(left, [max(0, x) for x in room], turn, capacity is not None))
        placed = placed.unionByName(got.where("shard >= 0").select("digest", "shard"))
        left, before, n_left, rest = got.where("shard < 0").select("digest", "bytes"), n_left, 0, 0
        for k, size, n in got.groupBy("shard").agg(F.sum("bytes"), F.count(F.lit(1))).collect():  # a row a shard
            if k >= 0:
                room[k] -= size
            else:
                rest, n_left = size, n
        if n_left * 2 > before:
            room += [capacity] * -(-rest // capacity)
        turn += 1
    rows = rows.join(placed, "digest")
    rows = common.cut(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-n_rows // CELL_ROWS))))))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("at", within).join(base, ["shard", "cell"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
