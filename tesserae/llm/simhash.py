"""SimHash near-dedup: exact comparison of fingerprint tiles by exclusive-or and bit counts.

Documents with one fingerprint are folded first, so a hot group of copies is one fingerprint. Distinct
fingerprints are dealt into tiles of one population count each and at most about `tile` rows; only tiles whose
counts differ by no more than the radius can hold a link, the other tile pairs are never built. A task compares
one pair of tiles with numpy and returns a spanning forest of its links, never all pairs. The number of
comparisons is quadratic in the distinct fingerprints (the method is exact, without an index), but a task's
memory and its share of the work are bounded by the tile.

The pipeline's stage (five words, a Jaccard coefficient of 0.8) doesn't compare all: a radius wide enough for it skips no
tiles. Texts of one shingle set are folded first. A sketch of each set, the least hash in each of BINS ranges
(one-permutation min-hash), is cut into bands, and sets that share a band meet: most links are found so (at 0.8 some 5 of
100,000 pairs share none). None is lost: sets of one link share a shingle among the first size - ceil(0.8 size) + 1 of each
in any order that is the same for all, so sets of unlike components that share one of these meet as well. The order puts
common shingles last; it decides what meets in vain, not what is found. Bands and shingles of the same members meet
once, those of many members in pairs of tiles. Of what meets, sizes and parities of shingles (a lower bound of how many two
sets don't share) leave out pairs that can't be alike, and the sets decide, so every link is exact and all count (equality
of shingles is that of 64-bit hashes). A task sends a spanning forest.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other;
fewer words than a shingle are one shingle; a null doc_id takes part in links but never names a component (a
component of null ids only has a null id); repeated rows are kept, each with the same result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packs

WORDS, SEED, RADIUS, TILE = 3, 42, 3, 24_576
ALIKE_WORDS, SIMILARITY, BINS, EMPTY = 5, 0.8, 128, 0xFFFF
BAND, BANDS = 5, 25  # a pair at 0.8 misses one band with 1 - 0.8 ** 5, all of them with 5e-5: what is missed is found by prefixes
PARITIES, WIDE, LARGE, SLACK = 1024, 16_384, 1024, 1e-9  # bits of parities; the wide ones are kept of sets over LARGE
OFTEN, COMMON = 3, 50_000  # sets of a thousand that make a shingle common, and how many common shingles are put in order
ALIKE_TILE, TILE_SHINGLES, BROADCAST = 8192, 4 << 20, 1_000_000
FLUSH = 1 << 20  # shingles of prefixes sent at once
CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The XXH64 of each of the text's word shingles, repeats included."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        total += np.unpackbits(h[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, by the upper 32 bits of its hashes, the least following 16 bits in each bin of the upper seven; EMPTY where there are none."""
    out = np.full((len(sets), BINS), EMPTY, np.uint16)
    if sets:
        h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        np.minimum.at(out, (of, h >> np.uint32(25)), np.minimum((h >> np.uint32(9)) & np.uint32(0xFFFF), EMPTY - 1).astype(np.uint16))
    return out


def bands(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each band of each sketch, and whether the band has a filled bin: without one it says nothing."""
    cut = sketch[:, : BAND * BANDS].reshape(len(sketch), BANDS, BAND)
    h = np.broadcast_to(packs.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), cut.shape[:2])
    for k in range(BAND):
        h = packs.mix(h ^ packs.mix(cut[:, :, k].astype(np.uint64) + np.uint64(1)))
    return h.view(np.int64), (cut != EMPTY).any(axis=2)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, words: int = WORDS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys as longs, fp) of each row; fp is the fingerprint as a signed long."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.texts(batches):
            fp = np.fromiter((fingerprint(shingles(x, words)) for x in rows), np.uint64, len(rows)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fp)], [*keys, "fp"])

    schema = ", ".join(f"`{k}` long" for k in keys) + ", fp long"
    return docs.select(*(F.col(k).cast("long") for k in keys), F.col("text").cast("string")).mapInArrow(run, schema)


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, which it changes, after the links (i, j)."""
    while len(i):
        ri, rj = root[i], root[j]
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while (root[root] != root).any():
            root[:] = root[root]
    return root


def forest(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between tiles x and y (or within x, if y is x), as places in x followed by y."""
    root = np.arange(len(x) + len(y))
    step = max(1, (1 << 22) // max(1, len(y)))
    for at in range(0, len(x), step):
        near = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius
        flat = np.flatnonzero(near)
        united(root, flat // len(y) + at, flat % len(y) + len(x))
    child = np.flatnonzero(root != np.arange(len(root)))
    return child, root[child]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of all links between prints (node, fp)."""
    spark = prints.sparkSession
    prints = prints.select("node", "fp", F.bit_count("fp").cast("int").alias("ones"))
    held = dict(prints.groupBy("ones").count().collect())  # 65 rows at most
    if not held:
        return spark.createDataFrame([], "a long, b long")
    split = [-(-held.get(p, 0) // tile) for p in range(65 + radius)]
    n_pairs = sum(n * (n + 1) // 2 + n * sum(split[p + 1 : p + radius + 1]) for p, n in enumerate(split))
    split_col = F.array(*map(F.lit, split))
    tiles = (
        prints.groupBy("ones", F.pmod(F.xxhash64("node"), F.element_at(split_col, F.col("ones") + 1)).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("node", "fp")).alias("held"))
    )

    def others(sign: int):
        """The tiles that this one meets, with counts from its own up (sign 1) or down (-1), each pair once."""
        steps = F.sequence(F.lit(0), F.lit(radius))

        def at(d):
            other = F.col("ones") + sign * d
            n = F.when(other.between(0, 64), F.element_at(split_col, F.greatest(F.least(other, F.lit(64)), F.lit(0)) + 1)).otherwise(0)
            first = F.when(d == 0, F.col("part")).otherwise(0) if sign > 0 else F.lit(0)
            last = n - 1 if sign > 0 else F.when(d == 0, F.col("part")).otherwise(n - 1)
            parts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(parts, lambda q: F.struct(other.alias("ones"), q.alias("part")))

        return F.explode(F.flatten(F.transform(steps, at))).alias("other")

    own = F.struct("ones", "part")
    low = tiles.select(others(1), own.alias("own"), "held").select(F.struct("own", "other").alias("pair"), F.lit(0).alias("side"), "held")
    high = tiles.select(others(-1), own.alias("own"), "held").select(F.struct(F.col("other").alias("own"), F.col("own").alias("other")).alias("pair"), F.lit(1).alias("side"), "held")

    def read(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        node, fp = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "fp"))
        return node, fp.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = pair = None
        for batch in batches:
            for k in range(batch.num_rows):
                tile_rows = read(batch.column(2)[k].values)
                if batch.column(1)[k].as_py() == 0:
                    waiting, pair = tile_rows, batch.column(0)[k].as_py()
                    continue
                if pair != batch.column(0)[k].as_py():  # a tile that no row fell into
                    continue
                a, b = forest(waiting[1], tile_rows[1], radius)
                nodes = np.concatenate([waiting[0], tile_rows[0]])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    sides = low.unionByName(high).repartition(max(1, min(n_pairs, 20_000)), "pair").sortWithinPartitions("pair", "side")
    return sides.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for each row of docs: n_same rows share the fingerprint."""
    rows = common.cut(fingerprints(docs, words))
    prints = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_same")))
    prints = prints.withColumn("node", F.xxhash64("fp"))  # one to one on longs
    prints = prints.join(common.components(links(prints, radius, tile)), "node", "left")
    prints = prints.select("fp", "first", "n_same", F.coalesce("root", "node").alias("root"))
    ids = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    prints = prints.join(ids, "root").select("fp", "component_id", "n_same")
    return rows.join(prints, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def parities(sets: list[np.ndarray], bits: int = PARITIES) -> np.ndarray:
    """For each set so many bits: whether an odd number of its hashes falls on each. Where two differ, the sets do as well."""
    h = np.concatenate(sets) % np.uint64(bits)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    out = np.zeros((len(sets), bits // 8), np.uint8)
    np.bitwise_xor.at(out, (of, (h >> np.uint64(3)).astype(np.int64)), (1 << (h & np.uint64(7))).astype(np.uint8))
    return out.view(np.uint64)


def near(size: np.ndarray, odd: np.ndarray, side: np.ndarray, of: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that sizes and parities leave, of unlike components (of) and, unless there is one, sides; some at a time, the likeliest of these first."""
    one = (side == side[0]).all()
    step = max(1, (1 << 20) // len(size))
    for at in range(0, len(size), step):
        rows = slice(at, at + step)
        can = np.minimum(size[rows, None], size[None, :]) >= (similarity - SLACK) * np.maximum(size[rows, None], size[None, :])
        can &= (np.arange(len(size))[None, :] > np.arange(at, at + len(can))[:, None]) & (of[rows, None] != of[None, :])
        if not one:
            can &= side[rows, None] != side[None, :]
        i, j = np.nonzero(can)
        i, apart = i + at, np.empty(len(i))
        for k in range(0, len(i), CHUNK):
            x, y = i[k : k + CHUNK], j[k : k + CHUNK]
            apart[k : k + CHUNK] = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1) / np.maximum(size[x] + size[y], 1)
        left = np.flatnonzero(apart <= (1 - similarity) / (1 + similarity) + SLACK)
        left = left[np.argsort(apart[left], kind="stable")]
        yield i[left], j[left]


def alike_forest(sets: list[np.ndarray], side: np.ndarray, of: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between components (of) by pairs of alike sets: those on unlike sides, or all if there is one side."""
    _, first, place = np.unique(of, return_index=True, return_inverse=True)
    old = first[place]
    root = old.copy()
    for i, j in near(np.array([len(x) for x in sets]), parities(sets), side, of, similarity):
        for k in range(0, len(i), 256):
            a, b = i[k : k + 256], j[k : k + 256]
            unlike = root[a] != root[b]
            a, b = a[unlike], b[unlike]
            sure = np.fromiter((jaccard(sets[x], sets[y]) >= similarity for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
            united(root, a[sure], b[sure])
    child = np.flatnonzero(root != old)
    return child, root[child]


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingles(text, words))


def banded(docs: DataFrame, row: str, words: int) -> DataFrame:
    """(row, doc_id, node, size, bands, odd, wide) of each row: its shingle set's hash, its size, the hashes of its bands, its parities.

    Beside them, on one row of a thousand, the shingles that OFTEN of their sets hold (common), and how many (times).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.texts(batches):
            for k in range(0, len(rows), 1000):
                sets = [shingle_set(x, words) for x in rows[k : k + 1000]]
                node = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
                h, filled = bands(sketches(sets))
                ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[filled]))
                _, unlike = np.unique(node, return_index=True)
                common_, times = np.unique(np.concatenate([sets[j] for j in unlike.tolist()]), return_counts=True)
                often = times >= OFTEN
                ends = np.minimum(np.arange(len(sets) + 1), 1) * int(often.sum())
                told = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[often].astype(np.int64))) for x in (common_.view(np.int64), times)]
                odd = [pa.array([x.tobytes() for x in parities(sets)], pa.binary()), pa.array([parities([x], WIDE).tobytes() if len(x) > LARGE else None for x in sets], pa.binary())]
                columns = [*batch.slice(k, 1000).columns[:2], pa.array(node), pa.array([len(x) for x in sets], pa.int64()), held, *odd, *told]
                yield pa.RecordBatch.from_arrays(columns, [row, "doc_id", "node", "size", "bands", "odd", "wide", "common", "times"])

    return docs.select(row, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"`{row}` long, doc_id long, node long, size long, bands array<long>, odd binary, wide binary, common array<long>, times array<long>")


def among(docs: DataFrame, rows: DataFrame, row: str, how: str) -> DataFrame:
    """docs joined with rows, which are broadcast if they are BROADCAST at most (counted)."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST else rows, row, how)


def alike_links(docs: DataFrame, prints: DataFrame, row: str, words: int, tile: int, similarity: float) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of the alike sets of prints (node, row, size, bands) that share a band."""
    members = prints.select("node", row, "size", F.explode("bands").alias("key"))
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    held = held.where("n > 1").groupBy("n", "shingles", "x", "y").agg(F.min("key").alias("key"))  # bands of the same members once
    members = members.join(held.select("key", tiles(tile)), "key").select(F.col("node").alias("of"), row, "key", "split")
    return compared(docs, common.cut(members), row, words, similarity)


def tiles(tile: int) -> Column:
    return F.ceil(F.greatest(F.col("n") / tile, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("split")


def compared(docs: DataFrame, members: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) of components that alike sets of one key link; members (key, row, of, split), sets being made again from docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in common.texts(batches):
            for k in range(0, len(rows), 1000):
                held = [shingle_set(x, words).tobytes() for x in rows[k : k + 1000]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1000), pa.array(held, pa.binary())], [row, "held"])

    sets = among(docs, members.select(row).distinct(), row, "left_semi").select(row, F.col("text").cast("string")).mapInArrow(run, f"`{row}` long, held binary")

    def found(side: np.ndarray, of: np.ndarray, _: np.ndarray, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b = alike_forest([np.frombuffer(x, np.uint64) for x in held], side, of, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(of[a]), pa.array(of[b])], ["a", "b"])

    return dealt(members.join(sets, row), row, "held").mapInArrow(by_unit(found), "a long, b long")


def dealt(members: DataFrame, row: str, held: str) -> DataFrame:
    """(key, p, q, part, of, row, held) of members (key, row, of, split, held) for each pair (p, q) of tiles of a key, in order."""
    part = F.pmod(F.xxhash64(row), F.col("split")).cast("int")
    met = members.select("key", "of", row, held, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("other"))
    met = met.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "of", row, held)
    return met.repartition(common.partitions(members.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q")


def by_unit(found: Callable) -> Callable:
    """A function of Arrow batches of dealt(): found(part, of, row, held) of each (key, p, q) that has two members or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for key, p, q, *r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (key, p, q):
                    yield from told(rows)
                    unit, rows = (key, p, q), []
                rows.append(r)
        yield from told(rows)

    def told(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            part, of, row, held = zip(*rows, strict=True)
            yield from found(np.array(part), np.array(of, np.int64), np.array(row, np.int64), held)

    return run


def prefix_of(sets: list[np.ndarray], often: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first size - ceil(similarity * size) + 1 hashes of each set, and which set's they are: rare ones by hash, then those of often by place."""
    size = np.array([len(x) for x in sets])
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    rank = np.zeros(len(h), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        rank = np.where(often[at] == h, place[at] + 1, 0)
    order = np.lexsort((h, rank, of))
    most = np.minimum(size - np.ceil((similarity - SLACK) * size).astype(np.int64) + 1, size)
    nth = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    first = nth < np.repeat(most, size)
    return h[order][first], of[first]


def missed_links(docs: DataFrame, rows: DataFrame, prints: DataFrame, row: str, words: int, tile: int, similarity: float) -> DataFrame:
    """Edges (a, b) of the components (root) of prints (row, root, size, odd) that any alike sets link; rows are those of banded().

    Hashes of prefixes go in sorted blobs by range (48 bits: unlike ones that are taken for equal only meet in vain). What
    meets is told by its members, so that shingles of the same members meet once, and left out within one component. Sizes
    and parities meet first; sets are made and sent only for the pairs that these leave.
    """
    told = rows.select(F.explode(F.arrays_zip("common", "times")).alias("v")).groupBy("v.common").agg(F.sum("v.times").alias("n"))
    told = told.orderBy(F.desc("n"), "common").limit(COMMON).collect()  # bounded; their order is all that they decide
    often = np.array([x.common for x in told], np.int64).view(np.uint64)
    by = np.argsort(often)
    often, place = often[by], (len(often) - by).astype(np.int64)  # the most common last
    n = common.partitions(docs.sparkSession)

    def send(tokens: list[np.ndarray], of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, r = np.concatenate(tokens), np.concatenate(of)
        order = np.argsort(h, kind="stable")
        h, r = h[order], r[order]
        part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        ends = np.searchsorted(part, np.arange(n + 1, dtype=np.uint64))
        full = [k for k in range(n) if ends[k] < ends[k + 1]]
        keys = [packs.pack_keys(h[ends[k] : ends[k + 1]] >> np.uint64(16)) for k in full]
        held = [packs.planes(r[ends[k] : ends[k + 1]]) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["part", "keys", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, of, waiting = [], [], 0
        for batch, texts in common.texts(batches):
            ids = batch.column(0).to_numpy()
            for k in range(0, len(texts), 1000):
                h, at = prefix_of([shingle_set(x, words) for x in texts[k : k + 1000]], often, place, similarity)
                tokens.append(h)
                of.append(ids[k + at])
                waiting += len(h)
                if waiting >= FLUSH:
                    yield from send(tokens, of)
                    tokens, of, waiting = [], [], 0
        if waiting:
            yield from send(tokens, of)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, held = None, [], []
        for batch in batches:
            for p, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from shared(keys, held)
                    part, keys, held = p, [], []
                keys.append(packs.unpack_keys(x))
                held.append(packs.unplanes(y, np.int64))
        yield from shared(keys, held)

    def shared(keys: list[np.ndarray], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        k, r = np.concatenate(keys), np.concatenate(held)
        order = np.argsort(k, kind="stable")
        k, r = k[order], r[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        many = np.diff(starts, append=len(k))
        said = np.repeat(np.add.reduceat(packs.mix(r.view(np.uint64) + np.uint64(1)), starts), many).view(np.int64)
        said, r = said[np.repeat(many > 1, many)], r[np.repeat(many > 1, many)]
        for at in range(0, len(r), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(said[at : at + CHUNK]), pa.array(r[at : at + CHUNK])], ["key", row])

    copies = common.cut(rows.select(row).join(prints.select(row), row, "left_anti"))
    blobs = among(docs, copies, row, "left_anti").select(row, F.col("text").cast("string")).mapInArrow(run, "part int, keys binary, held binary")
    members = blobs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(meet, f"key long, `{row}` long").distinct()
    members = common.cut(members.join(prints.select(row, F.col("root").alias("of"), "size"), row))
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high")
    members = members.join(held.select("key", tiles(tile)), "key")

    def pairs(side: np.ndarray, of: np.ndarray, row_: np.ndarray, held: list[dict]) -> Iterator[pa.RecordBatch]:
        known = all(x["odd"] is not None for x in held)
        odd = np.frombuffer(b"".join(x["odd"] for x in held), np.uint64).reshape(len(held), -1) if known else np.zeros((len(held), 1), np.uint64)
        for i, j in near(np.array([x["size"] for x in held]), odd, side, of, similarity):
            low, high = (f(row_[i], row_[j]).view(np.uint64) for f in (np.minimum, np.maximum))
            key = packs.mix(packs.mix(low + np.uint64(1)) ^ high).view(np.int64)
            for k in range(0, len(i), CHUNK):
                both = [np.concatenate([x[i[k : k + CHUNK]], x[j[k : k + CHUNK]]]) for x in (row_, of)]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(key[k : k + CHUNK], 2)), *map(pa.array, both), pa.array(np.ones(len(both[0]), np.int32))], ["key", row, "of", "split"])

    for sizes, odd in ((prints, "odd"), (rows, "wide")):
        known = members.join(sizes.select(row, F.struct("size", F.col(odd).alias("odd")).alias("held")), row)
        members = common.cut(dealt(known, row, "held").mapInArrow(by_unit(pairs), f"key long, `{row}` long, of long, split int").distinct())
    return compared(docs, members, row, words, similarity)


def keep_one(docs: DataFrame, words: int = ALIKE_WORDS, tile: int = ALIKE_TILE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs of each component of alike texts: that of the smallest doc_id, null ids last; of equals, one."""
    row = common.prefix_for(docs) + "row"
    docs_ = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = common.stored(banded(docs_, row, words))
    rank = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("rank")
    prints = common.cut(rows.groupBy("node").agg(rank, F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    prints = prints.withColumn(row, F.col("rank")[row])
    roots = common.components(alike_links(docs_, prints, row, words, tile, similarity))
    prints = common.cut(prints.select("node", "rank", row, "size", "odd").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    more = common.components(missed_links(docs_, rows, prints, row, words, tile, similarity)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    prints = prints.join(more, "root", "left").withColumn("root", F.coalesce("to", "root"))
    kept = prints.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank")[row].alias(row))
    dropped = common.cut(rows.select(row).join(kept, row, "left_anti"))
    return among(docs_, dropped, row, "left_anti").drop(row).select(*docs.columns)
