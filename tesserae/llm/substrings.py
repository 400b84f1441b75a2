"""Substring dedup by fixed-block anchors, over word windows.

Every document's non-overlapping blocks of window/2 words are the index. A window of that many words anywhere in
another text that repeats `window` words of it covers one of those blocks whole. So all rolling block-sized windows
probe the index (hashes of 40 bits in sorted blobs, see packs.py), and only around hits are the full windows hashed
(64 bits) and asked which document has each first: that extends hits to the maximal exact repeats, as a repeat is
the union of its windows. Equality of windows is that of 64-bit hashes.

Defined cases: null texts have no words; documents shorter than a window keep all; rows that share a doc_id are
ordered by their pack and then their text, null ids come first; every row is kept and gets a result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, packs
from .packs import Pack

WINDOW, BITS = 20, 40
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_sums(p: Pack, strong: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, packs.Sums]:
    """Words (start, end, document) and the prefix sums of their hashes."""
    starts, ends, doc = p.words()
    return starts, ends, doc, packs.prefix(packs.word_hashes(p.bytes, starts, ends), 0, strong)


def windows(sums: packs.Sums, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of so many words within a document."""
    at = np.arange(max(0, len(doc) - size + 1))
    at = at[doc[at] == doc[at + size - 1]] if len(at) else at
    return at, packs.span(sums, at, at + size)


def bit(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbit(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def block_keys(p: Pack, block: int) -> tuple[np.ndarray, packs.Sums, np.ndarray, np.ndarray, np.ndarray]:
    _, _, doc, sums = word_sums(p, 2 * block >= packs.LONG)
    at, h = windows(sums, doc, block)
    first = np.searchsorted(doc, doc[at]) if len(at) else at  # the document's first word
    return doc, sums, at, h >> np.uint64(64 - BITS), (at - first) % block == 0


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs."""
    block = window // 2
    stored = packs.pack(docs)
    n = packs.buckets(stored)

    def probe(pack: int, p: Pack, _) -> Iterator[pa.RecordBatch]:
        *_, keys, indexed = block_keys(p, block)
        keys, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        index = np.zeros(len(keys), bool)
        index[inverse[indexed]] = True
        if len(keys):
            yield packs.entries(pack, keys, BITS, n, lambda s: bit(index[s]) + bit(count[s] > 1))

    def hits(_, keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
        flags = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in extras]
        index = np.concatenate([unbit(f[0].tobytes(), len(k)) for f, k in zip(flags, keys, strict=True)])
        many = np.concatenate([unbit(f[1].tobytes(), len(k)) for f, k in zip(flags, keys, strict=True)])
        _, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        known, twice = np.zeros(len(count), bool), count > 1
        known[inverse[index]] = True
        twice[inverse[many]] = True
        hit = (known & twice)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return [bit(x) for x in np.split(hit, ends[:-1])]

    def candidates(p: Pack, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, hash) of the full windows around hits."""
        doc, sums, at, keys, _ = block_keys(p, block)
        distinct, inverse = np.unique(keys, return_inverse=True)
        edges = packs.split(distinct, BITS, n)
        hit = np.zeros(len(distinct), bool)
        for b, raw in answers:
            hit[edges[b] : edges[b + 1]] = unbit(raw, edges[b + 1] - edges[b])
        near = np.zeros(len(doc) + 1, np.int64)
        near[1:][at[hit[inverse]]] = 1
        near = np.cumsum(near)
        start, h = windows(sums, doc, window)
        near = near[start + window - block + 1] > near[start]
        return doc[start[near]], start[near], h[near]

    def extend(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        doc, _, h = candidates(p, answers)
        keys, first = np.unique(h, return_index=True)
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i in p.ids], np.int64)
        if len(keys):
            yield packs.entries(pack, keys, 64, n, lambda s: packs.planes(ids[doc[first[s]]]))

    def earlier(names: list[int], keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
        """The keys of each blob that another pack has in an earlier document."""
        which = np.repeat(np.arange(len(names)), [len(k) for k in keys])
        every, ids = np.concatenate(keys), np.concatenate([packs.unplanes(x, np.int64) for x in extras])
        order = np.lexsort((which, ids, every))
        later = np.zeros(len(every), bool)
        later[order[1:]] = every[order[1:]] == every[order[:-1]]
        return [packs.pack_keys(k[m]) for k, m in zip(keys, np.split(later, np.cumsum([len(k) for k in keys])[:-1]), strict=True)]

    def remove(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        starts, ends, doc, sums = word_sums(p, window >= packs.LONG)
        at, h = windows(sums, doc, window)
        again = np.ones(len(at), bool)
        again[np.unique(h, return_index=True)[1]] = False
        known = np.concatenate([packs.unpack_keys(raw) for _, raw in answers]) if answers else np.empty(0, np.uint64)
        if len(known):
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            again |= known[place] == h
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        bounds = np.searchsorted(doc, np.arange(len(p.ids) + 1))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for k, i in enumerate(p.ids):
            a, b = bounds[k], bounds[k + 1]
            kept = np.flatnonzero(~gone[a:b]) + a
            words = [p.raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]
            for column, x in zip(out, (i, int(b - a), int(b - a - len(kept)), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    hit = packs.ask(packs.each(stored, probe, packs.ENTRIES), n, hits)
    seen = packs.ask(packs.each(packs.answered(stored, hit), extend, packs.ENTRIES), n, earlier)
    return common.finished(packs.each(packs.answered(stored, seen), remove, SCHEMA), stored)


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest([array_to_string(w[i : i + {WINDOW - 1}], ' ') FOR i IN range(1, len(w) - {WINDOW - 2})]) AS s,
             unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM r),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT words.doc_id, count(gone.k) AS n, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS s
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
