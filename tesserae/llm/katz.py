"""LM scoring by a Katz back-off bigram model.

P(w | h) = d(c) * c / c(h), with c = c(h w), where the training texts have h w, else alpha(h) * P(w); d are Good-Turing
discounts for counts up to K and 1 above. P(w) is the discounted unigram share, and what the discounts free goes to
the one class of unknown words. alpha(h) hands the mass freed after h to the words not seen after it, exactly:
(1 - sum of seen P(w | h)) / (1 - sum of seen P(w)). A history whose counts free nothing gives 1 / (c(h) + 1).
Where Good-Turing on the raw count-of-counts gives a discount that isn't between 0 and 1 (ragged, as by groups of
copies), an order's discounts are Good-Turing on smoothed ones: the log-linear fit of n1 to n(K + 1), with gaps
averaged in. A slope under -1 always gives discounts between 0 and 1. Only where there is no such slope, or no n1, are
they absolute ones: (c - b) / c with b = n1 / (n1 + 2 n2), a half if that is 0 or 1.

Texts are packs and n-gram counts are tables partitioned by key range (packs.py): word counts first; then each pack
sends its distinct bigrams, with the word's count, to the history's partition, which holds all that follows it and
so finds c(h) and alpha(h). Histories with more than a partition's share of all tokens are dealt out by the following
word as well, and their sums are added up before. Packs get back counts and alphas and evaluate token by token.
Words are keyed by 64-bit hashes; in bigrams 48 bits stand for the history and 40 for the word.

Defined cases: a null text is empty: its only token is the end; a null id is never held out; with no training text
every token is unknown and the score is that of one class, 0; repeated rows and ids are kept (and learned from as
often); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packs
from .packs import Pack

FOLDS, FOLD, K, PACK_BYTES, BUCKET_BYTES = 7, 2, 5, 5 << 20, 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END, BEGIN = np.uint64(1), np.uint64(2)  # no word hashes to less than 16, see tokens()
H_BITS = 48
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None, folds: int = FOLDS, fold: int = FOLD) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def good_turing(n: np.ndarray, k: int) -> np.ndarray:
    """The Good-Turing discounts d[1] to d[k] from the count-of-counts n[1] to n[k + 1]; nan if there are none."""
    c = np.arange(1, k + 1)
    if not n[1 : k + 1].all() or (k + 1) * n[k + 1] >= n[1]:
        return np.full(k, np.nan)
    common_part = (k + 1) * n[k + 1] / n[1]
    return ((c + 1) * n[c + 1] / (c * n[c]) - common_part) / (1 - common_part)


def smoothed(n: np.ndarray) -> np.ndarray:
    """The log-linear fit of n[1] and on, each that isn't 0 shared out over half the way to its neighbours."""
    r = np.flatnonzero(n)
    if len(r) < 2:
        return np.zeros(len(n))
    before, after = np.concatenate([[0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    slope, at = np.polyfit(np.log(r), np.log(2 * n[r] / (after - before)), 1)
    return np.concatenate([[0], np.exp(at + slope * np.log(np.arange(1, len(n))))])


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d[c] for counts 0 to k (d[0] is unused), from the count-of-counts n[1] to n[k + 1]."""
    raw = np.array([0, *n[1 : k + 2]], float)
    for estimate in (raw, smoothed(raw)) if n[1] else ():
        d = good_turing(estimate, k)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d])
    b = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    b = b if 0 < b < 1 else 0.5
    return np.array([1.0, *((c - b) / c for c in range(1, k + 1))])


@dataclass
class Unigrams:
    """The word order: all tokens, distinct ones and the discounts."""

    tokens: int
    distinct: int
    d: np.ndarray
    scale: float
    unknown: float

    def p(self, count: np.ndarray) -> np.ndarray:
        """The probability of words with these counts; of the unknown class for 0."""
        if not self.tokens:
            return np.ones(len(count))
        return self.scale * discounted(count, self.d) / self.tokens + np.where(count > 0, 0.0, self.unknown)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1.0) * count


def tokens(p: Pack) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token in order, and the document of each; a document's last is its end."""
    starts, ends, doc = p.words()
    h = packs.word_hashes(LOWER[p.bytes], starts, ends)
    h = np.where(h < 16, h + np.uint64(16), h)
    n = len(p.ids)
    doc = np.concatenate([doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([h, np.full(n, END)])[order], doc[order]


def bigrams(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The history of each token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = BEGIN
    return packs.mix(before) >> np.uint64(64 - H_BITS)


def follow(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(24)


def pairs(history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct (history, word), in order, and each token's number among them."""
    order = np.lexsort((word, history))
    a, b = history[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def deal(history: np.ndarray, word: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The partition of each pair: by range of the history, or for hot ones by the word."""
    out = (history >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(H_BITS - 16)
    return np.where(np.isin(history, hot), packs.mix(word) % np.uint64(buckets), out).astype(np.int64)


def score(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, k: int = K, size: int = PACK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    stored = packs.pack(docs, size)
    n = packs.buckets(stored, BUCKET_BYTES)

    def training(p: Pack, doc: np.ndarray) -> np.ndarray:
        return ~np.array([held_out(i, folds, fold) for i in p.ids], bool)[doc]

    def ask_words(pack: int, p: Pack, _) -> Iterator[pa.RecordBatch]:
        h, doc = tokens(p)
        keys, of = np.unique(h, return_inverse=True)
        count = np.bincount(of, training(p, doc), len(keys)).astype(np.int64)
        yield packs.entries(pack, keys, 64, n, lambda s: packs.planes(count[s]))

    def count_words(names: list[int], keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate([packs.unplanes(x, np.int64) for x in extras]), len(every)).astype(np.int64)
        return [packs.planes(x) for x in np.split(total[of], np.cumsum([len(x) for x in keys])[:-1])]

    def word_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in packs.by_bucket(batches):
            every, of = np.unique(np.concatenate([packs.unpack_keys(r[1]) for r in held]), return_inverse=True)
            total = np.bincount(of, np.concatenate([packs.unplanes(r[2], np.int64) for r in held]), len(every)).astype(np.int64)
            row = [int(total.sum()), int((total > 0).sum()), *(int((total == c).sum()) for c in range(1, k + 2))]
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.int64()))], ["stats"])

    words = packs.dealt(packs.each(stored, ask_words, packs.ENTRIES), n).persist(StorageLevel.MEMORY_AND_DISK)
    sums = words.mapInArrow(word_stats, "stats array<long>").agg(*(F.sum(F.col("stats")[j]) for j in range(k + 3))).first()
    sums = [x or 0 for x in sums]
    d1 = discounts([0, *sums[2:]], k)
    freed = sum((1 - d1[c]) * c * sums[1 + c] for c in range(1, k + 1)) / max(1, sums[0])
    unknown = max(freed, 1 / (sums[0] + 1))
    uni = Unigrams(sums[0], sums[1], d1, (1 - unknown) / (1 - freed) if sums[0] else 1.0, unknown)
    counted = packs.answer_dealt(words, count_words)
    limit = max(1, uni.tokens // n)

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in packs.by_bucket(batches):
            every, of = np.unique(np.concatenate([packs.unpack_keys(r[1]) for r in held]), return_inverse=True)
            total = np.bincount(of, np.concatenate([packs.unplanes(r[2], np.int64) for r in held]), len(every))
            yield pa.RecordBatch.from_arrays([pa.array((packs.mix(every[total > limit]) >> np.uint64(64 - H_BITS)).astype(np.int64), pa.int64())], ["h"])

    # A word is hot if it has more than a partition's share of the tokens: there are fewer such words than partitions.
    hot = np.array(sorted(r[0] for r in words.mapInArrow(hot_words, "h long").collect()) + [int(packs.mix(np.array([BEGIN]))[0] >> np.uint64(64 - H_BITS))], np.uint64)
    told = packs.answered(stored, counted)

    def counts(h: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """The training count of each token."""
        _, of = np.unique(h, return_inverse=True)
        return np.concatenate([packs.unplanes(raw, np.int64) for b, raw in answers if b < n])[of]

    def ask_pairs(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        h, doc = tokens(p)
        c = counts(h, answers)
        history, word = bigrams(h, doc), follow(h)
        at, of = pairs(history, word)
        seen = np.bincount(of, training(p, doc), len(at)).astype(np.int64)
        own = deal(history[at], word[at], hot, n)
        for b in np.unique(own).tolist():
            on = np.flatnonzero(own == b)
            low = np.ascontiguousarray(word[at[on]].view(np.uint8).reshape(-1, 8)[:, :5])
            extra = [packs.squeeze(np.ascontiguousarray(low.T).tobytes()), packs.planes(seen[on]), packs.planes(c[at[on]])]
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([b], pa.int32()), pa.array([packs.pack_keys(history[at[on]])], pa.binary()), pa.array([packs.join(extra)], pa.binary())], ["pack", "bucket", "keys", "extra"])

    def table(keys: list[np.ndarray], extras: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all pairs of a partition: each row's number, and of each distinct pair its history, count and P(word)."""
        history, words_, seen, c = np.concatenate(keys), [], [], []
        for x in extras:
            w, s, u = packs.unjoin(x)
            s = packs.unplanes(s, np.int64)
            wide = np.zeros((len(s), 8), np.uint8)
            wide[:, :5] = np.frombuffer(packs.unsqueeze(w), np.uint8).reshape(5, -1).T
            words_.append(wide.view(np.uint64).ravel())
            seen.append(s)
            c.append(packs.unplanes(u, np.int64))
        at, of = pairs(history, np.concatenate(words_))
        count = np.bincount(of, np.concatenate(seen), len(at)).astype(np.int64)
        return of, history[at], count, uni.p(np.concatenate(c)[at])

    def history_sums(history: np.ndarray, count: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct histories, and for each: sum of seen P(word), n1 to nk of what follows, and the counts above k."""
        every, of = np.unique(history, return_inverse=True)
        m = len(every)
        columns = [np.bincount(of, p * (count > 0), m), *(np.bincount(of, count == c, m) for c in range(1, k + 1)), np.bincount(of, np.where(count > k, count, 0), m)]
        return every, np.stack(columns, axis=1)

    def pair_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count-of-counts under history -1, and the partial sums of hot histories."""
        for held in packs.by_bucket(batches):
            _, history, count, p = table([packs.unpack_keys(r[1]) for r in held], [r[2] for r in held])
            on = np.isin(history, hot)
            every, rows = history_sums(history[on], count[on], p[on])
            all_counts = [[0.0, *(float((count == c).sum()) for c in range(1, k + 2))]]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *every.tolist()], pa.int64()), pa.array([*all_counts, *rows.tolist()], pa.list_(pa.float64()))], ["h", "v"])

    dealt = packs.dealt(packs.each(told, ask_pairs, packs.ENTRIES), n).persist(StorageLevel.MEMORY_AND_DISK)
    found = {r[0]: [x or 0.0 for x in r[1:]] for r in dealt.mapInArrow(pair_stats, "h long, v array<double>").groupBy("h").agg(*(F.sum(F.col("v")[j]) for j in range(k + 2))).collect()}
    d2 = discounts([int(x) for x in found.pop(-1, [0.0] * (k + 2))], k)
    hot_rows = {h: np.array(v) for h, v in found.items()}

    def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(h), the scale of seen probabilities, and alpha(h)."""
        c = np.arange(1, k + 1)
        total = rows[:, 1 : k + 1] @ c + rows[:, k + 1]
        kept = rows[:, 1 : k + 1] @ (d2[1:] * c) + rows[:, k + 1]
        share = np.divide(kept, total, out=np.zeros(len(rows)), where=total > 0)
        most = total / (total + 1)
        scale = np.where(share > most, np.divide(most, share, out=np.ones(len(rows)), where=share > 0), 1.0)
        free = np.maximum(1 - rows[:, 0], 1e-300)
        return total, scale, np.where(total > 0, (1 - share * scale) / free, 1.0)

    def count_pairs(names: list[int], keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
        of, history, count, p = table(keys, extras)
        every, rows = history_sums(history, count, p)
        for j in np.flatnonzero(np.isin(every, hot)).tolist():
            rows[j] = hot_rows[int(every[j])]
        total, scale, alpha = settle(rows)
        out, at = [], 0
        for k_ in keys:
            own = np.searchsorted(every, np.unique(k_))
            out.append(packs.join([packs.planes(count[of[at : at + len(k_)]]), packs.planes(total[own].astype(np.int64)), packs.planes(scale[own]), packs.planes(alpha[own])]))
            at += len(k_)
        return out

    def evaluate(pack: int, p: Pack, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        h, doc = tokens(p)
        c = counts(h, answers)
        history, word = bigrams(h, doc), follow(h)
        at, of = pairs(history, word)
        own = deal(history[at], word[at], hot, n)
        seen, total, scale, alpha = (np.zeros(len(at)) for _ in range(4))
        for b, raw in answers:
            if b >= n:
                on = np.flatnonzero(own == b - n)
                s, t, sc, al = packs.unjoin(raw)
                _, which = np.unique(history[at[on]], return_inverse=True)
                seen[on] = packs.unplanes(s, np.int64)
                total[on], scale[on], alpha[on] = packs.unplanes(t, np.int64)[which], packs.unplanes(sc, np.float64)[which], packs.unplanes(al, np.float64)[which]
        direct = discounted(seen.astype(np.int64), d2) * scale / np.maximum(total, 1)
        with np.errstate(divide="ignore"):
            logp = np.log10(np.where(seen[of] > 0, direct[of], alpha[of] * uni.p(c)))
        base = np.log10((c + 1) / (uni.tokens + uni.distinct + 1))
        m = len(p.ids)
        columns = [p.ids, [held_out(i, folds, fold) for i in p.ids], np.bincount(doc, minlength=m), np.bincount(doc, c > 0, m).astype(np.int64), [uni.tokens] * m, np.bincount(doc, base, m), np.bincount(doc, logp, m)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    paired = packs.answer_dealt(dealt, count_pairs).withColumn("bucket", F.col("bucket") + n)
    out = common.finished(packs.each(packs.answered(stored, counted.unionByName(paired)), evaluate, SCHEMA), stored)
    dealt.unpersist()
    words.unpersist()
    return out
