"""Quality rules by repetition coverage: how many of a text's characters lie inside repeated n-grams and lines.

The words of many texts are numbered and laid end to end. A rolling hash is carried from one length to the next
(h * B + value of the next word, modulo 2^64), equal hashes within one text are found by sorting, and the words of
neighbours in the sort are compared, so that a collision can't count. An n-gram that repeats begins with a shorter one that
repeats, so each length only looks at the places that the length before it left. The characters of all words inside
repeated n-grams, the first occurrence included, are the coverage of a length; those of lines that repeat an
earlier line are the coverage of lines.

Words are `[^\\x20\\x09-\\x0D]+`; characters are code points. A text fails the base rules with fewer than `least` words, or
with over `most` per cent of them inside repeated windows of `window` words. It is kept if it doesn't and if no length, nor
the lines, cover more than their limit of its word characters. Limits are about twice the usual ones for repeats alone,
as first occurrences are counted here.

Defined cases: a null text has no words, like an empty one: all counts are 0 and the base rules fail; lines without a word
are never repeats; rows are judged one by one, so repeated rows, ties and null ids are kept, each with its own
verdict; an empty table gives no rows; other columns are ignored (judged) or kept (keep_good); a text of any length is one
piece of work of a task, with some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of word characters that repeated n-grams of each length may cover, and repeated lines.
LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
LINE_LIMIT, LEAST, WINDOW, MOST = 0.30, 20, 8, 30
SYMBOLS = b"#*$%&|<>"
CHUNK = 1 << 21  # bytes of texts that are measured at once
BASE = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words")


def chunks(raws: Iterable[bytes | None], size: int = CHUNK) -> Iterator[list[bytes]]:
    """The texts in lists of about `size` bytes; a longer text is a list of its own."""
    held: list[bytes] = []
    total = 0
    for raw in raws:
        raw = raw or b""
        if held and total + len(raw) > size:
            yield held
            held, total = [], 0
        held.append(raw)
        total += len(raw)
    if held:
        yield held


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(at: np.ndarray, keys: np.ndarray, same) -> np.ndarray:
    """Those of the places `at` whose window is found at another place too; same(x, y) tells whether windows are equal."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    pair = np.flatnonzero(keys[1:] == keys[:-1])
    hit = np.zeros(len(at), bool)
    if len(pair):
        equal = same(at[pair], at[pair + 1])
        if equal.all():
            hit[pair] = hit[pair + 1] = True
        else:  # unlike windows share a hash: compare all of that hash with each other
            for key in np.unique(keys[pair[~equal]]):
                run = np.flatnonzero(keys == key)
                for k in run:
                    hit[k] = same(np.repeat(at[k], len(run) - 1), at[run[run != k]]).any()
            fine = pair[equal & ~np.isin(keys[pair], keys[pair[~equal]])]
            hit[fine] = hit[fine + 1] = True
    return np.sort(at[hit])


def line_repeats(raw: bytes) -> tuple[int, int]:
    """The lines with a word that equal an earlier one, and the characters of their words."""
    if b"\n" not in raw:
        return 0, 0
    seen, n, chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if not line.strip():
            continue
        if line in seen:
            n += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        seen.add(line)
    return n, chars


def measures(raws: list[bytes], lengths: Iterable[int] = tuple(LIMITS), window: int = WINDOW, hashed=mixed) -> tuple[np.ndarray, np.ndarray]:
    """For each text, a row of COUNTS and a row with the characters covered at each length."""
    lengths = sorted(lengths)
    split = [raw.split() for raw in raws]  # of bytes: at exactly the six ASCII blanks
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = list(chain.from_iterable(split))
    index = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in index), np.int64, len(index))[ids]
    doc = np.repeat(np.arange(len(raws)), n)
    del split, flat, index
    total = len(ids)
    summed = lambda x: np.bincount(doc, x, len(raws)).astype(np.int64)

    value, salt = hashed(ids), mixed(doc + total)
    h, at = value.copy(), np.arange(total)
    covered = np.zeros((len(raws), len(lengths)), np.int64)
    words = np.zeros(len(raws), np.int64)
    for k in range(1, max([window, *lengths]) + 1):
        if k > 1:
            h = h[: max(0, total - k + 1)] * BASE + value[k - 1 :]
        if k not in lengths and k != window:
            continue
        at = at[at <= total - k]
        at = at[doc[at] == doc[at + k - 1]]
        same = lambda x, y, k=k: np.logical_and.reduce([doc[x] == doc[y], *(ids[x + j] == ids[y + j] for j in range(k))])
        at = repeated(at, h[at] ^ salt[at], same)
        if not len(at):
            break
        edge = np.zeros(total + 1, np.int32)
        edge[at] += 1
        edge[at + k] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        if k in lengths:
            covered[:, lengths.index(k)] = summed(chars * inside)
        if k == window:
            words = summed(inside)
    lines = np.array([line_repeats(raw) for raw in raws], np.int64).reshape(-1, 2)
    symbols = np.fromiter((len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws), np.int64, len(raws))
    return np.column_stack([n, summed(chars), symbols, lines, words]), covered


def measured(lengths: tuple[int, ...], window: int):
    """A function from a text column to a struct of COUNTS and the covered characters by length."""
    names = [*COUNTS, *(f"dup_chars_{k}" for k in lengths)]

    @F.arrow_udf(", ".join(f"{c} long" for c in names))
    def measure(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            rows = [np.hstack(measures(x, lengths, window)) for x in chunks(array.cast(pa.large_binary()).to_pylist())]
            table = np.vstack(rows) if rows else np.empty((0, len(names)), np.int64)
            yield pa.StructArray.from_arrays([pa.array(c) for c in table.T], names)

    return lambda text: measure(text.cast("string"))


def verdict(m, limits: dict[int, float], line_limit: float, least: int, most: int):
    """The columns base_failed and kept of a struct that measured() made."""
    failed = (m["n_words"] < least) | (100 * m["n_repeat_words"] > most * m["n_words"])
    good = m["dup_line_chars"] <= line_limit * m["word_chars"]
    for k, limit in limits.items():
        good &= m[f"dup_chars_{k}"] <= limit * m["word_chars"]
    return failed, ~failed & good


def judged(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, least: int = LEAST, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, dup_chars_<length> ...)."""
    limits = dict(sorted((limits or LIMITS).items()))
    rows = docs.select("doc_id", measured(tuple(limits), window)(F.col("text")).alias("m"))
    failed, kept = verdict(F.col("m"), limits, line_limit, least, most)
    first = [f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *first, failed.alias("base_failed"), kept.alias("kept"), "m.dup_line_chars", *(f"m.dup_chars_{k}" for k in limits))


def keep_good(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, least: int = LEAST, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    limits, m = dict(sorted((limits or LIMITS).items())), common.prefix_for(docs) + "m"
    rows = docs.withColumn(m, measured(tuple(limits), window)(F.col("text")))
    return rows.where(verdict(F.col(m), limits, line_limit, least, most)[1]).drop(m)


def sql(limits: dict[int, float] | None = None) -> str:
    limits = limits or LIMITS
    lengths = sorted({*limits, WINDOW})
    kept = " AND ".join([f"l.c <= {LINE_LIMIT} * b.word_chars", *(f"coalesce(c{k}.c, 0) <= {limits[k]} * b.word_chars" for k in limits)])
    failed = f"(b.n_words < {LEAST} OR 100 * coalesce(c{WINDOW}.n, 0) > {MOST} * b.n_words)"
    parts = "".join(
        f""", s{k} AS (SELECT r, p, list_aggregate(list_slice(ws, p::BIGINT, p::BIGINT + {k - 1}), 'string_agg', ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - {k - 2})) AS p FROM t)),
c{k} AS (SELECT r, count(*) AS n, sum(length(w)) AS c FROM (SELECT DISTINCT r, p + unnest(range(0, {k})) AS p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM s{k}) WHERE n > 1) JOIN w USING (r, p) GROUP BY r)"""
        for k in lengths
    )
    joins = " ".join(f"LEFT JOIN c{k} USING (r)" for k in lengths)
    return rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM t),
b AS (SELECT t.r, t.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t),
i AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT t.r, count(i.line) AS n, coalesce(sum(length(regexp_replace(i.line, '[\x20\x09-\x0D]', '', 'g'))), 0)::BIGINT AS c FROM t LEFT JOIN i ON t.r = i.r AND i.k > 1 GROUP BY t.r){parts}
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, l.n AS n_dup_lines, coalesce(c{WINDOW}.n, 0) AS n_repeat_words, {failed} AS base_failed, NOT {failed} AND {kept} AS kept, l.c AS dup_line_chars, {", ".join(f"coalesce(c{k}.c, 0)::BIGINT AS dup_chars_{k}" for k in sorted(limits))}
FROM b JOIN l USING (r) {joins}"""


SQL = sql()
