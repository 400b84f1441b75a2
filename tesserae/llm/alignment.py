"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents link each pair.

Texts are encoded once, and the token ids are stored. A first pass over them aligns each text: the byte ends of both
tokenizations cut it into pieces, each of which lies in one token of A and one of B, a link; where both end, a group ends.
A task counts the documents of each distinct (A id, B id) pair in sorted arrays, dealt by key range.

Of the distinct pairs of a range a minimal perfect hash is made (levels of bit arrays: keys that collide on one level go on to
the next; a key's number is the rank of its bit). Tasks' counts become dense vectors indexed by it, and these are summed
as a tree of fixed fan-in. Each slot holds its key, so that a pair which isn't in the table is told from one that is.
A second pass aligns the stored ids again and looks up the counts. Up to `most` pairs the table is broadcast (some 13
bytes a pair; pairs are counted first). Beyond, links are joined with it as rows.

A: byte-level BPE (a tokenizers JSON without a normalizer), encoded by its ranks. B: a sentencepiece BPE model. Where no piece
of B holds a space after another character, each stretch of spaces and the word behind it are encoded on their own, once
for all texts of a task (a memo of bounded size); else texts are encoded whole. Token bytes are those of A's entry, and
of B's piece with U+2581 as a space and <0xHH> as a byte.

Defined cases: texts that are null or empty, or whose tokens' bytes differ from a space and the text, have no tokens: counts
of 0 and an empty digest; a repeated row counts as a document of its own; null ids are kept; an empty table gives no
rows; other columns are ignored; a long text is aligned whole by one task (some 60 bytes a token).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How GPT-2 style byte-level BPE splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGES, FAN, MOST = 64, 64, 16_000_000
CHUNK, HELD, MEMO, GAMMA, LEVELS = 1 << 21, 1 << 20, 300_000, 2.0, 24


# Tokenizers.


def unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE of a tokenizers JSON file, by ranks."""

    def __init__(self, raw: bytes):
        import tiktoken

        spec = json.loads(raw)
        kind, vocab, merges = spec["pre_tokenizer"] or {}, spec["model"]["vocab"], spec["model"]["merges"]
        special = {x["content"] for x in spec["added_tokens"]}
        order = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in merges]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"] or order != sorted(order):
            raise ValueError("not a plain byte-level BPE whose ids follow its merges")
        of = unicode_bytes()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("some byte has no token")
        self.size = max(vocab.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        self.model = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.model.encode_to_numpy(" " + text, disallowed_special=())


class PieceBPE:
    """A sentencepiece BPE model that adds a space."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        pieces = [p.piece for p in spec.pieces]
        norm, train = spec.normalizer_spec, spec.trainer_spec
        plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not train.treat_whitespace_as_suffix
        # Types: 1 normal, 2 unknown, 3 control, 6 byte. User-defined pieces (4) would be matched over word ends.
        self.by_word = plain and train.model_type == 2 and all(p.type in (1, 2, 3, 6) for p in spec.pieces) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.size = len(pieces)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.memo: dict[str, bytes | None] = {}
        self.space = array("I", [self.model.piece_to_id("▁")]).tobytes()

    def ids(self, text: str, got: list[int]) -> bytes | None:
        """Ids as bytes, or None where the tokens' bytes aren't those of a space and the text."""
        return array("I", got).tobytes() if b"".join(map(self.bytes.__getitem__, got)) == b" " + text.encode() else None

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        if not self.by_word:
            raws = [self.ids(x, y) for x, y in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]
            return [None if x is None else np.frombuffer(x, np.uint32) for x in raws]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, out = self.memo, []
        memo[""] = self.space
        split = []
        for text in texts:
            parts = text.split(" ")
            split.append([x[1:] for x in re.findall(" +[^ ]*", " " + text)] if "" in parts else parts)
        new = list({x for parts in split for x in parts if x not in memo})
        for word, got in zip(new, self.model.encode(new, num_threads=1), strict=True):
            memo[word] = self.ids(word, got)
        for parts in split:
            try:
                out.append(np.frombuffer(b"".join(map(memo.__getitem__, parts)), np.uint32))
            except TypeError:  # a word without tokens
                out.append(None)
        return out


@lru_cache(maxsize=2)
def tokenizers_of(a: bytes, b: bytes) -> tuple[ByteBPE, PieceBPE]:
    return ByteBPE(a), PieceBPE(b)


def sizes(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token id of A and B."""
    x, y = tokenizers_of(a, b)
    return x.lengths, y.lengths


# Alignment of many texts, laid end to end.


class Links(NamedTuple):
    """Links of texts, in order: the position of the token of A and of B, whether a group ends; the text of each token of A."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def links(a: np.ndarray, b: np.ndarray, text: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> Links:
    """All texts are cut at once: tokens of both cover the same bytes of each, so ends only grow from text to text."""
    x, y = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    ends = np.concatenate([x, y])
    ends.sort(kind="stable")  # two sorted runs are merged
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    at, bt = np.searchsorted(x, ends), np.searchsorted(y, ends)
    return Links(at, bt, (x[at] == ends) & (y[bt] == ends), text)


def spelled(a: np.ndarray, b: np.ndarray, link: Links, n_texts: int, words: list[np.ndarray]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text. words: the ids of A followed by , or | and those of B followed by , or ;"""
    last = np.flatnonzero(link.ends)
    a_end, b_end = link.a[last], link.b[last]  # the last token of each group
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_end] = b_last[b_end] = True
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    before_a = np.concatenate([[0], b_end + 1])[group_a] if len(last) else group_a
    before_b = (a_end + 1)[group_b] if len(last) else group_b
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + before_a] = np.where(a_last, words[1][a], words[0][a])
    out[np.arange(len(b)) + before_b] = np.where(b_last, words[3][b], words[2][b])
    tokens = np.bincount(link.text, minlength=n_texts) + np.bincount(link.text[a_end[group_b]], minlength=n_texts) if len(last) else np.zeros(n_texts, np.int64)
    cuts = np.concatenate([[0], np.cumsum(tokens)])
    held = out.tolist()
    return [b"".join(held[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def spellings(n_a: int, n_b: int) -> list[np.ndarray]:
    made = []
    for n, signs in ((n_a, b",|"), (n_b, b",;")):
        for sign in signs:
            column = np.empty(n, object)
            column[:] = [b"%d%c" % (i, sign) for i in range(n)]
            made.append(column)
    return made


# Stored encodings: ids as bytes, 16 bits each where both vocabularies allow it.


def encoded(docs: DataFrame, a: bytes, b: bytes, width: str) -> DataFrame:
    """(doc_id, _a, _b): the token ids of each row's text; null where the text has no tokens."""
    kind = np.dtype(width)

    @F.arrow_udf("a binary, b binary")
    def encode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        byte, piece = tokenizers_of(a, b)
        for column in arrays:
            out: list[tuple[bytes, bytes] | tuple[None, None]] = []
            for texts in batches(column.to_pylist(), len):
                held = [x or "" for x in texts]
                for text, got in zip(held, piece.encode(held), strict=True):
                    ids = byte.encode(text) if text and got is not None else None
                    fits = ids is not None and int(byte.lengths[ids].sum()) == int(piece.lengths[got].sum())
                    out.append((ids.astype(kind).tobytes(), got.astype(kind).tobytes()) if fits else (None, None))
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.StructArray.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    return docs.select("doc_id", encode(F.col("text").cast("string")).alias("ids")).select("doc_id", F.monotonically_increasing_id().alias("row"), "ids.a", "ids.b")


def batches(items: Iterable, size: Callable, most: int = CHUNK) -> Iterator[list]:
    """items in lists of about `most` by size; null counts as 0."""
    held, total = [], 0
    for x in items:
        n = size(x) if x is not None else 0
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held


def tokens(rows: list[tuple[bytes | None, bytes | None]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of A and B of many texts, end to end, and the text of each token of A."""
    a = [np.frombuffer(x or b"", kind) for x, _ in rows]
    text = np.repeat(np.arange(len(rows)), [len(x) for x in a])
    flat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.empty(0, np.int64)
    return flat(a), flat([np.frombuffer(x or b"", kind) for _, x in rows]), text


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[list[tuple[bytes | None, bytes | None]]]:
    a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
    yield from batches(zip(a, b, strict=True), lambda r: len(r[0] or b"") + len(r[1] or b""))


# Counts of documents by pair.


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def pair_counts(stored: DataFrame, a: bytes, b: bytes, width: str, ranges: int) -> DataFrame:
    """(p, k, keys, counts): the pairs of range p that task k met, sorted, and in how many of its documents."""
    kind = np.dtype(width)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a_len, b_len = sizes(a, b)
        n_b, all_pairs = len(b_len), len(a_len) * len(b_len)
        task = TaskContext.get().partitionId()
        keys, counts, held = [], [], 0

        def dealt() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            p = mixed(k, 99) % np.uint64(ranges)
            order = np.argsort(p, kind="stable")
            k, c, p = k[order], c[order], p[order]
            cuts = np.searchsorted(p, np.arange(ranges + 1))
            used = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
            blobs = [[x[cuts[i] : cuts[i + 1]].tobytes() for i in used] for x in (k, c)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([task] * len(used), pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["p", "k", "keys", "counts"])

        for batch in parts:
            for rows in rows_of(batch):
                x, y, text = tokens(rows, kind)
                link = links(x, y, text, a_len, b_len)
                each = np.unique(text[link.a] * all_pairs + x[link.a] * n_b + y[link.b])  # a pair of a text once
                k, c = np.unique(each % all_pairs, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > HELD:
                    k, c = summed(keys, counts)
                    if len(k) > HELD // 2:
                        keys, counts = [k], [c]
                        yield dealt()
                        keys, counts = [], []
                    else:
                        keys, counts = [k], [c]
                    held = sum(map(len, keys))
        if keys:
            yield dealt()

    return stored.where("a IS NOT NULL").select("a", "b").mapInArrow(count, "p int, k long, keys binary, counts binary")


class PerfectHash:
    """A minimal perfect hash of distinct keys: levels of bit arrays, a key's number being the rank of its bit."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        left, level = keys, 0
        while len(left) and level < LEVELS:
            size = int(GAMMA * len(left)) // 64 * 64 + 64
            slot = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            self.bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left, level = left[~alone[slot]], level + 1
        self.rest = np.sort(left)
        self.ranked()

    def ranked(self) -> None:
        """The number of bits before each word of the bit arrays."""
        ones = [np.bitwise_count(x).astype(np.int64) for x in self.bits]
        done = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.before = [np.cumsum(x) - x + at for x, at in zip(ones, done[:-1], strict=True)]
        self.n = int(done[-1]) + len(self.rest)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, 0 to n - 1; of a key that isn't one of the set any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            slot = (mixed(keys[open_], level) % np.uint64(64 * len(bits))).astype(np.int64)
            word, bit = bits[slot >> 6], (slot & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = before[slot[hit] >> 6] + np.bitwise_count(low[hit])
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == keys[open_], self.n - len(self.rest) + at, -1)
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.bits), len(self.rest), *map(len, self.bits)], np.int64)
        return b"".join([head.tobytes(), *(x.tobytes() for x in self.bits), self.rest.astype(np.int64).tobytes()])

    @classmethod
    def unpacked(cls, raw: bytes) -> PerfectHash:
        out, words = cls.__new__(cls), np.frombuffer(raw, np.int64)
        levels, rest = int(words[0]), int(words[1])
        cuts = np.cumsum([2 + levels, *words[2 : 2 + levels]])
        out.bits = [words[i:j].view(np.uint64) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        out.rest = words[cuts[-1] : cuts[-1] + rest]
        out.ranked()
        return out


def blobs(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in table.column(name).to_pylist()]


def one(schema: dict[str, pa.DataType], **values) -> pa.Table:
    return pa.table({c: pa.array([values[c]], t) for c, t in schema.items()})


P_K = {"p": pa.int32(), "k": pa.int64()}


def tree(rows: DataFrame, merge: Callable[[pa.Table], pa.Table], top: int) -> DataFrame:
    """One row for each p: rows (p, k, ...) merged by FAN of k at a time, until `top`, the greatest k, is 0."""
    schema = rows.schema
    while True:
        rows = rows.withColumn("k", F.expr(f"k div {FAN}")).groupBy("p", "k").applyInArrow(merge, schema)
        top //= FAN
        if top == 0:
            return rows


def union(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(blobs(table, "keys")))
    return one(P_K | {"keys": pa.binary()}, p=table["p"][0].as_py(), k=table["k"][0].as_py(), keys=keys.tobytes())


def hashed(table: pa.Table) -> pa.Table:
    """The hash of the keys of a range, and the keys in the order of their numbers."""
    keys = blobs(table, "keys")[0]
    mph = PerfectHash(keys)
    ordered = np.empty(mph.n, np.int64)
    ordered[mph.numbers(keys)] = keys
    return one({"p": pa.int32(), "n": pa.int64(), "mph": pa.binary(), "keys": pa.binary()}, p=table["p"][0].as_py(), n=mph.n, mph=mph.packed(), keys=ordered.tobytes())


def dense(counted: pa.Table, mph: pa.Table) -> pa.Table:
    """The counts of FAN tasks in one vector, indexed by the hash."""
    hash_ = PerfectHash.unpacked(mph["mph"][0].as_py())
    vector = np.zeros(hash_.n, np.int64)
    for keys, counts in zip(blobs(counted, "keys"), blobs(counted, "counts"), strict=True):
        vector[hash_.numbers(keys)] += counts  # keys of a row are distinct
    return one(P_K | {"vector": pa.binary()}, p=counted["p"][0].as_py(), k=counted["k"][0].as_py(), vector=vector.tobytes())


def added(table: pa.Table) -> pa.Table:
    vectors = blobs(table, "vector")
    total = vectors[0].copy()
    for v in vectors[1:]:
        total += v
    return one(P_K | {"vector": pa.binary()}, p=table["p"][0].as_py(), k=table["k"][0].as_py(), vector=total.tobytes())


def count_table(counts: DataFrame) -> DataFrame:
    """(p, n, mph, keys, vector) of each range: the hash, the keys and the counts by number, from rows of pair_counts()."""
    top = counts.agg(F.max("k")).first()[0] or 0
    tables = common.stored(tree(counts.select("p", "k", "keys"), union, top).groupBy("p").applyInArrow(hashed, "p int, n long, mph binary, keys binary"))
    dealt = counts.withColumn("k", F.expr(f"k div {FAN}"))
    each = dealt.select(F.col("p").alias("q"), F.col("k").alias("j")).distinct().join(tables, F.col("q") == F.col("p")).select("q", "j", "mph")
    vectors = dealt.groupBy("p", "k").cogroup(each.groupBy("q", "j")).applyInArrow(dense, "p int, k long, vector binary")
    return common.stored(tables.join(tree(vectors, added, top // FAN).select("p", "vector"), "p"))


def pairs(table: DataFrame, n_b: int) -> DataFrame:
    """(a, b, n): each pair and its count, as rows."""

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for keys, counts in zip(*([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("keys", "vector")), strict=True):
                for at in range(0, len(keys), HELD):
                    k = keys[at : at + HELD]
                    yield pa.RecordBatch.from_arrays([pa.array((k // n_b).astype(np.int32)), pa.array((k % n_b).astype(np.int32)), pa.array(counts[at : at + HELD])], ["a", "b", "n"])

    return table.select("keys", "vector").mapInArrow(spread, "a int, b int, n long")


class Counts:
    """The counts of pairs, by the hashes of their ranges; the highest count of each id of A."""

    def __init__(self, rows: list, ranges: int, n_a: int, n_b: int):
        self.ranges = ranges
        narrow = np.uint32 if n_a * n_b < 1 << 32 else np.uint64
        self.of = {r.p: (PerfectHash.unpacked(bytes(r.mph)), np.frombuffer(r.keys, np.int64).astype(narrow), np.frombuffer(r.vector, np.int64)) for r in rows}
        self.best = np.zeros(n_a, np.int64)
        for _, keys, counts in self.of.values():
            np.maximum.at(self.best, keys.astype(np.int64) // n_b, counts)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 of one that no document holds."""
        out = np.zeros(len(keys), np.int64)
        p = (mixed(keys, 99) % np.uint64(self.ranges)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        cuts = np.searchsorted(p[order], np.arange(self.ranges + 1))
        for i, (mph, held, counts) in self.of.items():
            at = order[cuts[i] : cuts[i + 1]]
            number = mph.numbers(keys[at])
            found = (number >= 0) & (held[number] == keys[at])
            out[at[found]] = counts[number[found]]
        return out


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def measured(rows: list, kind: np.dtype, a_len: np.ndarray, b_len: np.ndarray, words: list[np.ndarray], counts: Counts | None) -> tuple[np.ndarray, list[bytes]]:
    """For each text a row of MEASURES (the last two 0 without counts), and its groups spelled out."""
    x, y, text = tokens(rows, kind)
    link = links(x, y, text, a_len, b_len)
    by = text[link.a]
    size = lambda at, weights=None: np.bincount(at, weights, len(rows)).astype(np.int64)
    n_b = np.array([len(r[1] or b"") // kind.itemsize for r in rows], np.int64)
    best = total = np.zeros(len(rows), np.int64)
    if counts is not None:
        keys, back = np.unique(x[link.a] * len(b_len) + y[link.b], return_inverse=True)
        count = counts(keys)[back]
        best = size(by[count == counts.best[x[link.a]]])
        edge = np.searchsorted(by, np.arange(len(rows) + 1))
        sums = np.concatenate([[0], np.cumsum(count)])  # integers: floats would round sums over 2^53
        total = sums[edge[1:]] - sums[edge[:-1]]
    return np.column_stack([size(text), n_b, size(by[link.ends]), size(by), best, total]), spelled(x, y, link, len(rows), words)


def looked_up(stored: DataFrame, a: bytes, b: bytes, width: str, counts) -> DataFrame:
    """(doc_id, row, MEASURES, groups): every stored row aligned again. counts: a broadcast list of table rows, or None."""
    kind = np.dtype(width)
    names = [*MEASURES, "groups"]

    @F.arrow_udf(", ".join(f"{c} long" for c in MEASURES) + ", groups string")
    def align_(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        a_len, b_len = sizes(a, b)
        words = spellings(len(a_len), len(b_len))
        by_pair = counts and Counts(counts.value, RANGES, len(a_len), len(b_len))
        for x, y in arrays:
            tables, groups = [], []
            for rows in rows_of(pa.RecordBatch.from_arrays([x, y], ["a", "b"])):
                m, g = measured(rows, kind, a_len, b_len, words, by_pair)
                tables.append(m)
                groups += g
            m = np.vstack(tables) if tables else np.empty((0, len(MEASURES)), np.int64)
            yield pa.StructArray.from_arrays([*(pa.array(c) for c in m.T), pa.array(groups, pa.binary()).cast(pa.string())], names)

    return stored.select("doc_id", "row", align_("a", "b").alias("m")).select("doc_id", "row", "m.*")


def linked_rows(stored: DataFrame, a: bytes, b: bytes, width: str) -> DataFrame:
    """(row, a, b, times): the distinct pairs of each stored row, and how often each is linked there."""
    kind = np.dtype(width)

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_len, b_len = sizes(a, b)
        n_b, all_pairs = len(b_len), len(a_len) * len(b_len)
        for batch in parts:
            ids, at = batch.column("row").to_numpy(zero_copy_only=False), 0
            for rows in rows_of(batch):
                x, y, text = tokens(rows, kind)
                link = links(x, y, text, a_len, b_len)
                each, times = np.unique(text[link.a] * all_pairs + x[link.a] * n_b + y[link.b], return_counts=True)
                key = each % all_pairs
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + each // all_pairs]), pa.array((key // n_b).astype(np.int32)), pa.array((key % n_b).astype(np.int32)), pa.array(times)], ["row", "a", "b", "times"])
                at += len(rows)

    return stored.where("a IS NOT NULL").select("row", "a", "b").mapInArrow(spread, "row long, a int, b int, times long")


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, MEASURES, groups) of each document, and the counts (a, b, n) of all linked pairs."""
    spark = docs.sparkSession
    a, b = (open(x, "rb").read() for x in (a_file, b_file))  # noqa: SIM115
    n_a, n_b = map(len, sizes(a, b))
    width = "uint16" if max(n_a, n_b) <= 1 << 16 else "uint32"
    stored = kept(spark, encoded(docs, a, b, width))
    table = count_table(kept(spark, pair_counts(stored, a, b, width, RANGES)))
    n = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = pairs(table, n_b)
    if n <= most:
        held = spark.sparkContext.broadcast(table.select("p", "mph", "keys", "vector").collect())
        return looked_up(stored, a, b, width, held), counted
    best = counted.groupBy("a").agg(F.max("n").alias("top"))
    each = linked_rows(stored, a, b, width).join(counted, ["a", "b"]).join(best, "a")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    rest = looked_up(stored, a, b, width, None).drop("n_best", "count_sum").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return rest.select("doc_id", "row", *MEASURES, "groups"), counted


def kept(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows stored in the shared folder, compressed well: ids and counts are dense numbers."""
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        return common.stored(rows)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, most: int = MOST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    rows, _ = alignment(docs, a_file, b_file, most)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *MEASURES, digest.alias("groups_sha256"))
