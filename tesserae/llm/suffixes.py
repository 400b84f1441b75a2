"""Suffix-array dedup by bucket-pointer refinement, as far as `length` bytes and over sampled suffixes.

Whether two strings of `length` bytes are equal is whether their suffixes fall into one bucket when buckets are
refined to that depth. Suffixes are sampled: each string of `length` bytes points to its anchor, the start of the
q-gram of least hash within it (the leftmost of equals), so equal strings point to equal anchors at equal offsets,
and an anchor stands for the run of strings that point to it. The initial buckets are the anchors' q-grams. A bucket
is refined by the identifiers of what lies at later and earlier offsets, recursively:

level 0: the whole run of an anchor: its bucket is the q-gram, the refined identifier all bytes the run covers;
level 1: steps of STEP strings: the bucket is what a step's strings share, the identifier all bytes they cover;
level 2: single strings.

A bucket of one is settled (nothing repeats); members with a common identifier are settled (all repeats); only the
others are refined further, together with one member of each settled identifier of their bucket, which is reused for
comparison. So exact copies are settled at level 0 whatever their number, and work remains only where repeats begin
and end. Equality of strings is that of 64-bit hashes.

Members meet by (bucket, identifier), each once a pack, as hashed blobs (packs.py): a very common q-gram in unlike
surroundings is one bucket, but is dealt out over all tasks. What a member has to know of its whole bucket, whether
there are others and whether some open one is alone, are sums: each task adds up its own part of every bucket, and a
second exchange by bucket adds up those parts, one a task at most.

Defined cases: a null text is empty; texts shorter than `length` keep all; every row is kept and gets a result, also
for null or repeated ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packs
from .packs import Pack

LENGTH, GRAM, STEP, PACK_BYTES = 400, 32, 32, 2 << 20
REPEATED, OPEN, SUPPLY = 1, 2, 4
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Nodes:
    """Runs of strings: anchor, first and last start, bucket, identifier, and whether they are still open."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bucket: np.ndarray
    name: np.ndarray
    open: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of distinct (bucket, name) in order, a place of each, and the number of each node's pair."""
        return np.unique(salted(self.bucket, self.name), return_index=True, return_inverse=True)


def salted(h: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    for x in numbers:
        h = packs.mix(h ^ packs.mix(np.asarray(x).astype(np.uint64) + np.uint64(0x51ED270B)))
    return h


def roots(p: Pack, length: int, gram: int) -> tuple[packs.Sums, Nodes]:
    """Prefix sums of the bytes, and the runs of all anchors."""
    sums = packs.prefix(p.bytes, 1)
    n, width = len(p.bytes), length - gram + 1
    empty = np.empty(0, np.int64)
    if not (p.ends - p.starts >= length).any():
        return sums, Nodes(empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool))
    grams = np.arange(n - gram + 1)
    g = (packs.rough(sums, grams, grams + gram) >> np.uint64(32) << np.uint64(32)) | grams.astype(np.uint64)
    rows = np.full(-(-len(g) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(g)] = g
    ahead = np.minimum.accumulate(rows.reshape(-1, width), axis=1).ravel()
    back = np.minimum.accumulate(rows.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], ahead[width - 1 : width - 1 + n - length + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = p.ends - p.starts
    long = sizes >= length
    whole = np.zeros(n + 1, np.int64)  # starts whose string ends within the document
    np.add.at(whole, p.starts[long], 1)
    np.add.at(whole, p.ends[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[: n - length + 1]) > 0)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    a = anchor[first]
    return sums, Nodes(a, low, high, packs.span(sums, a, a + gram), salted(packs.span(sums, low, high + length), a - low, high - low), np.ones(len(a), bool))


def steps(sums: packs.Sums, up: Nodes, length: int, step: int) -> Nodes:
    """The runs in steps of offsets from the anchor."""
    near, far = (up.anchor - up.high) // step, (up.anchor - up.low) // step
    of = np.repeat(np.arange(len(near)), far - near + 1)
    c = np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1) + near[of]
    a = up.anchor[of]
    low, high = np.maximum(up.low[of], a - c * step - step + 1), np.minimum(up.high[of], a - c * step)
    bucket = salted(packs.span(sums, a - c * step, a - c * step - step + 1 + length), c)
    return Nodes(a, low, high, bucket, salted(packs.span(sums, low, high + length), a - low, high - low), up.open[of])


def strings(sums: packs.Sums, up: Nodes, length: int) -> Nodes:
    """The single strings."""
    n = up.high - up.low + 1
    of = np.repeat(np.arange(len(n)), n)
    at = up.low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    h = packs.span(sums, at, at + length)
    return Nodes(up.anchor[of], at, at, h, h, up.open[of])


def select(nodes: Nodes, code: np.ndarray) -> Nodes:
    """What is refined further: open nodes, and those that supply a settled identifier."""
    on = (code & (OPEN | SUPPLY)) > 0
    still = nodes.open[on] & ((code[on] & OPEN) > 0)
    return Nodes(nodes.anchor[on], nodes.low[on], nodes.high[on], nodes.bucket[on], nodes.name[on], still)


MEETING = "pack int, packs binary, sizes binary, flags binary, place binary, buckets binary, sums binary"
PAIRED, OPENED, FIRST = 1, 2, 4  # of an entry: its identifier is there twice, it is open, it speaks for its identifier
SHARED, GOING = 1, 2  # of a bucket: it has two members or more, and an open one among them is alone


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of a range of (bucket, identifier): what each knows by itself, and the task's part of each bucket."""
    for held in packs.by_bucket(batches):
        keys = [packs.unpack_keys(r[1]) for r in held]
        rows = np.concatenate([packs.unplanes(r[2], np.uint8).reshape(-1, 9) for r in held])
        bucket = np.ascontiguousarray(rows[:, :8]).view(np.uint64).ravel()
        many, opened = rows[:, 8] & 1, (rows[:, 8] & 2) > 0
        _, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        paired = (np.bincount(of, 1 + many) >= 2)[of]
        speaks = np.zeros(len(of), bool)
        speaks[first] = True
        flags = (paired * PAIRED + opened * OPENED + speaks * FIRST).astype(np.uint8)
        own, place = np.unique(bucket, return_inverse=True)
        members = np.minimum(np.bincount(place, 1 + many), 2)
        alone = np.bincount(place, ~paired & opened) > 0
        sums = (members + 4 * alone).astype(np.uint8)
        sizes = np.array([len(k) for k in keys], np.int64)
        columns = [packs.planes(np.array([r[0] for r in held], np.int64)), packs.planes(sizes), packs.planes(flags), packs.planes(place.astype(np.int64)), packs.pack_keys(own), packs.planes(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([held[0][3]], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], [x.split()[0] for x in MEETING.split(", ")])


def add_up(_, keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """For each bucket of each task's part: what the parts say together."""
    parts = np.concatenate([packs.unplanes(x, np.uint8) for x in extras])
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(of, parts & 3) >= 2
    going = shared & (np.bincount(of, (parts & 4) > 0) > 0)
    out = (shared * SHARED + going * GOING).astype(np.uint8)[of]
    return [packs.planes(x) for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, bucket, answer): a code for each entry that a pack sent to a task."""
    for batch in batches:
        for r in batch.to_pylist():
            flags, place = packs.unplanes(r["flags"], np.uint8), packs.unplanes(r["place"], np.int64)
            known = np.concatenate([packs.unplanes(a["answer"], np.uint8) for a in r["answers"]])[place]
            paired, opened, speaks = ((flags & x) > 0 for x in (PAIRED, OPENED, FIRST))
            lone = ((known & SHARED) > 0) & ~paired
            code = paired * REPEATED | (lone & opened) * OPEN | (((known & GOING) > 0) & ((paired & speaks) | (lone & ~opened))) * SUPPLY
            names, sizes = packs.unplanes(r["packs"], np.int64), packs.unplanes(r["sizes"], np.int64)
            answers = [packs.planes(x) for x in np.split(code.astype(np.uint8), np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([r["pack"]] * len(names), pa.int32()), pa.array(answers, pa.binary())], ["pack", "bucket", "answer"])


def refine(asked: DataFrame, n: int) -> DataFrame:
    """(pack, bucket, answer) to what the packs asked."""
    met = common.stored(packs.dealt(asked, n).mapInArrow(meet, MEETING))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, buckets, sums in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sums = packs.unplanes(sums, np.uint8)
                yield packs.entries(task, packs.unpack_keys(buckets), 64, n, lambda s: packs.planes(sums[s]))  # noqa: B023

    told = packs.ask(met.select("pack", "buckets", "sums").mapInArrow(parts, packs.ENTRIES), n, add_up)
    rows = packs.answered(met, told).select("pack", "packs", "sizes", "flags", "place", "answers")
    return rows.mapInArrow(verdicts, "pack long, bucket int, answer binary")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, size: int = PACK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""
    stored = packs.pack(docs, size)
    n = packs.buckets(stored)

    def levels(p: Pack, answers: list[tuple[int, bytes]], upto: int) -> Iterator[tuple[Nodes, np.ndarray | None]]:
        """The nodes of each level with their codes; without codes for the last."""
        sums, nodes = roots(p, length, gram)
        for level in range(upto + 1):
            code = None
            if level < upto:
                _, _, of = nodes.pairs()
                own = [raw for b, raw in answers if b // n == level]
                code = np.concatenate([packs.unplanes(x, np.uint8) for x in own])[of] if own else np.empty(0, np.uint8)
            yield nodes, code
            if code is not None:
                kept = select(nodes, code)
                nodes = steps(sums, kept, length, step) if level == 0 else strings(sums, kept, length)

    def ask(level: int):
        def work(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            *_, (nodes, _) = levels(p, answers, level)
            if not len(nodes.bucket):
                return
            keys, at, of = nodes.pairs()
            flags = (np.bincount(of) > 1).astype(np.uint8) | ((np.bincount(of, nodes.open) > 0).astype(np.uint8) << 1)
            rows = np.hstack([nodes.bucket[at].view(np.uint8).reshape(-1, 8), flags[:, None]])
            yield packs.entries(pack, keys, 64, n, lambda s: packs.planes(np.ascontiguousarray(rows[s]).ravel()))

        return work

    def remove(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cover = np.zeros(len(p.bytes) + 1, np.int64)
        for nodes, code in levels(p, answers, 3):
            if code is not None and len(code):
                hit = nodes.open & ((code & REPEATED) > 0)
                np.add.at(cover, nodes.low[hit], 1)
                np.add.at(cover, nodes.high[hit] + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, a, b in zip(p.ids, p.starts.tolist(), p.ends.tolist(), strict=True):
            own = gone[a:b]
            removed = int(own.sum())
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            kept = p.bytes[a:b][~own].tobytes() if removed else p.raw[a:b]
            for column, x in zip(out, (i, b - a, removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    told, at = None, stored
    for level in range(3):
        got = refine(packs.each(at, ask(level), packs.ENTRIES), n).withColumn("bucket", (F.col("bucket") + level * n).cast("int"))
        got = common.stored(got)
        told = got if told is None else told.unionByName(got)
        at = packs.answered(stored, told)
    return common.finished(packs.each(at, remove, SCHEMA), stored)
