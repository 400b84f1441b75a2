"""Packs of texts, and questions that packs ask of all others through hashed buckets.

Some operators have to know, for every window of every text, whether it occurs elsewhere. As rows, the windows of
100 TB are far more bytes than the texts. So texts are stored once as packs (a few megabytes of documents, one row,
compressed), a task handles a pack at a time with numpy, and asks in blobs: for each hash bucket, the sorted
distinct keys of the pack, delta-coded. A bucket's task sees all packs' blobs of its key range, each key once a
pack however hot it is, and answers each blob. Spark moves packs, blobs and answers; nothing passes the driver.

Tables of packs are cut into buckets of about BUCKET bytes of text, and keys into as many ranges as their bytes ask
for, so that a task's share stays the same while the input grows. A pack sends one blob to each key range: from some
TB on, let packs grow with the input (`size`), or blobs get down to a few keys each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PACK_BYTES, BUCKET, MOST_BUCKETS = 4 << 20, 16 << 20, 200_000
ENTRIES = "pack long, bucket int, keys binary, extra binary"
R, R_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
PRIME, S = (1 << 31) - 1, 0x5DEECE66
S_INVERSE = pow(S, -1, PRIME)
CHUNK, LONG = 1 << 16, 512
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def planes(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) if len(a) else b""


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(raw), np.uint8).reshape(size, -1).T).view(dtype).ravel() if raw else np.empty(0, dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned longs as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


@cache
def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base to the power of each number, by two small tables."""
    top = int(at.max()) >> 16 if len(at) else 0
    high = powers(pow(base, CHUNK, 1 << 64), 1 << (top + 1).bit_length())
    return powers(base, CHUNK)[at & (CHUNK - 1)] * high[at >> 16]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a long over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def prime_powers(base: int, n: int) -> np.ndarray:
    """base to the powers below n, modulo PRIME, by doubling."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, PRIME)) % np.uint64(PRIME)
        k *= 2
    return out


Sums = tuple[np.ndarray, np.ndarray | None]


def prefix(values: np.ndarray, plus: int = 0, strong: bool = True) -> Sums:
    """Polynomial prefix sums of values + plus, modulo 2^64 and (strong) modulo a prime; a chunk at a time.

    The power of two is quick but has strings of LONG and more symbols that collide for every base (Thue-Morse words);
    the prime has not.
    """
    out, rest = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1 if strong else 0, np.uint32)
    shift, turn, p = np.uint64(1), np.uint64(1), np.uint64(PRIME)
    for k in range(0, len(values), CHUNK):
        v = values[k : k + CHUNK].astype(np.uint64) + np.uint64(plus)
        np.cumsum(v * powers(R, CHUNK)[: len(v)] * shift, out=out[k + 1 : k + 1 + len(v)])
        out[k + 1 : k + 1 + len(v)] += out[k]
        shift = np.uint64(int(shift) * pow(R, CHUNK, 1 << 64) & ((1 << 64) - 1))
        if not strong:
            continue
        if values.itemsize > 2:
            v %= p
        low = v * (prime_powers(S, CHUNK)[: len(v)] * turn % p)
        if values.itemsize > 2:
            low %= p
        rest[k + 1 : k + 1 + len(v)] = (np.cumsum(low) + np.uint64(rest[k])) % p
        turn = np.uint64(int(turn) * pow(S, CHUNK, PRIME) % PRIME)
    return out, rest if strong else None


def rough(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A quick hash of each stretch, equal for equal ones: to pick places by, not to compare stretches."""
    return mix((sums[0][ends] - sums[0][starts]) * power(R_INVERSE, starts) + (ends - starts).astype(np.uint64))


def span(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of values, of equal stretches wherever they stand; without the prime if sums aren't strong."""
    if sums[1] is None:
        return rough(sums, starts, ends)
    p = np.uint64(PRIME)
    top = int(starts.max()) >> 16 if len(starts) else 0
    back = prime_powers(S_INVERSE, CHUNK)[starts & (CHUNK - 1)]
    if top:
        back = back * prime_powers(pow(S_INVERSE, CHUNK, PRIME), 1 << (top + 1).bit_length())[starts >> 16] % p
    own = (sums[1][ends] + p - sums[1][starts]) % p * back % p
    return mix(rough(sums, starts, ends) + own * np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a buffer; the few of LONG bytes and more by XXH64."""
    h = rough(prefix(text, 1, strong=False), starts, ends)
    for k in np.flatnonzero(ends - starts >= LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(text[starts[k] : ends[k]].tobytes())
    return h


class Pack:
    """The documents of a stored pack: ids, whether each text is null, and the texts in one buffer."""

    def __init__(self, ids: list[int | None], sizes: bytes, text: bytes):
        self.ids = ids
        sizes = np.frombuffer(sizes, np.int64)
        self.null = sizes < 0
        self.ends = np.cumsum(np.maximum(sizes, 0))
        self.starts = self.ends - np.maximum(sizes, 0)
        self.raw = unsqueeze(text) if len(text) else b""
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word, in order."""
        gap = SPACE[self.bytes]
        before, after = np.ones(len(gap), bool), np.ones(len(gap), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        inner = self.starts[(self.starts > 0) & (self.starts < len(gap))]
        before[inner] = True
        after[inner - 1] = True
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        return starts, ends, np.searchsorted(self.ends, starts, side="right")


def pack(docs: DataFrame, size: int = PACK_BYTES) -> DataFrame:
    """A stored table (pack, ids, sizes, text) of the documents, sorted by id within a pack; texts whole."""

    def row(ids: list, rows: list) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, rows[k] or b""))
        ids, rows = [ids[k] for k in order], [rows[k] for k in order]
        sizes = np.array([-1 if x is None else len(x) for x in rows], np.int64).tobytes()
        text = squeeze(b"".join(x or b"" for x in rows), 3)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([text], pa.binary())], ["ids", "sizes", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch, texts in common.texts(batches):
            for i, x in zip(batch.column(0).to_pylist(), texts, strict=True):
                if ids and held + len(x or b"") > size:
                    yield row(ids, rows)
                    ids, rows, held = [], [], 0
                ids.append(i)
                rows.append(x)
                held += len(x or b"")
        if ids:
            yield row(ids, rows)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(-(-held // BUCKET), min(common.partitions(docs.sparkSession), -(-held // size)), 1), MOST_BUCKETS)
    rows = docs.mapInArrow(run, "ids array<long>, sizes binary, text binary")
    return common.stored(rows.select(F.monotonically_increasing_id().alias("pack"), "*"), by="pack", buckets=n)


def each(packs: DataFrame, work: Callable[[int, Pack, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(pack, its documents, its answers by bucket) over all packs; answers are there if answered() put them."""
    has = "answers" in packs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                answers = [(a["bucket"], a["answer"]) for a in batch.column(4)[k].as_py() or []] if has else []
                yield from work(batch.column(0)[k].as_py(), Pack(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()), answers)

    return packs.select("pack", "ids", "sizes", "text", *(["answers"] if has else [])).mapInArrow(run, schema)


def split(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys of so many bits starts and ends: buckets + 1 places."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def entries(pack: int, keys: np.ndarray, bits: int, buckets: int, extra: Callable[[slice], bytes]) -> pa.RecordBatch:
    """The blobs of one pack's sorted distinct keys, with what extra() says of the same slice of them."""
    at = split(keys, bits, buckets)
    full = [k for k in range(buckets) if at[k] < at[k + 1]]
    blobs = [pack_keys(keys[at[k] : at[k + 1]]) for k in full]
    return pa.RecordBatch.from_arrays(
        [pa.array([pack] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array([extra(slice(at[k], at[k + 1])) for k in full], pa.binary())],
        ["pack", "bucket", "keys", "extra"],
    )


def join(blobs: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def unjoin(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        end = at + 4 + int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : end])
        at = end
    return out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes, bytes, int]]]:
    """The rows (pack, keys, extra, bucket) of one bucket after the other, each released before the next."""
    held: list[tuple[int, bytes, bytes, int]] = []
    for batch in batches:
        for p, b, k, x in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if held and held[0][3] != b:
                yield held
                held = []
            held.append((p, k, x, b))
    if held:
        yield held


def dealt(asked: DataFrame, buckets: int) -> DataFrame:
    """The entries, each bucket's in one partition, in order of buckets and packs."""
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "pack")


def answer_dealt(rows: DataFrame, answer: Callable[[list[int], list[np.ndarray], list[bytes]], list[bytes]]) -> DataFrame:
    """(pack, bucket, answer): answer(packs, keys, extras) gets all blobs of one bucket and answers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            got = answer([r[0] for r in held], [unpack_keys(r[1]) for r in held], [r[2] for r in held])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[3] for r in held], pa.int32()), pa.array(got, pa.binary())], ["pack", "bucket", "answer"])

    return rows.mapInArrow(run, "pack long, bucket int, answer binary")


def ask(asked: DataFrame, buckets: int, answer: Callable[[list[int], list[np.ndarray], list[bytes]], list[bytes]]) -> DataFrame:
    return answer_dealt(dealt(asked, buckets), answer)


def answered(packs: DataFrame, answers: DataFrame) -> DataFrame:
    """The packs with the array of their answers by bucket; null where nothing was asked."""
    answers = answers.withColumnRenamed("pack", "p")
    if getattr(packs, "stored_in", None):  # as many partitions as the table has buckets: texts stay where they are
        answers = answers.repartition(packs.stored_in, "p")
    held = answers.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    return packs.join(held, F.col("pack") == F.col("p"), "left").drop("p")


def buckets(packs: DataFrame, per: int = 64 << 20) -> int:
    """So many that a bucket gets at most about `per` bytes of text; the session's partitions, if there are packs for them."""
    size, n = packs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    return max(min(common.partitions(packs.sparkSession), n), -(-3 * (size or 0) // per), 1)
