"""SimHash, substring and suffix dedup against brute force, on odd rows, in small packs and tiles."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import common, packs, simhash, substrings, suffixes


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fp = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], f"{fp[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [3, 1000])
def test_simhash_is_exact(odd, odd_rows, tile):
    got = Counter(tuple(r)[:3] for r in simhash.near_dedup(odd, tile=tile).collect())
    assert got == components(odd_rows)


def test_simhash_of_nothing(none):
    assert simhash.near_dedup(none).collect() == [] and simhash.keep_one(none).collect() == []


def alike(a, b):
    """The Jaccard coefficient of two texts' sets of five-word shingles."""
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return 1.0 if sets[0] == sets[1] else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("tile", [3, 1000])
def test_keep_one_keeps_one_of_each_group(odd, odd_rows, spark, tile):
    kept = simhash.keep_one(odd, tile=tile)
    assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    for k, (i, t) in enumerate(got):
        assert not any(alike(t, u) >= 0.9 for _, u in got[:k])
        assert i is None or all(j is None or j >= i or alike(t, u) < 0.9 for j, u, *_ in odd_rows)
    assert all(any(alike(t, u) > 0.7 for _, u in got) for _, t, *_ in odd_rows)
    many = spark.createDataFrame([(None, "one two three four five six")] * 3 + [(7, "one two three four five six")] * 2 + [(None, "a b")] * 2, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(many, tile=tile).collect()) == [(0, "a b"), (7, "one two three four five six")]


def test_near_copies_are_found_at_their_similarity(spark):
    """Recall at 0.85 and above, and precision at 0.75 and below, against exact Jaccard."""
    import random

    r = random.Random(11)
    rows, vocabulary = [], [f"w{k}" for k in range(500)]
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(40, 400))]
        rows.append((2 * i, " ".join(w)))
        for k in r.sample(range(len(w)), max(1, int(len(w) * r.choice([0.005, 0.01, 0.02, 0.05, 0.1])))):
            w[k] = "x" + w[k]
        rows.append((2 * i + 1, " ".join(w)))
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = [(alike(rows[2 * i][1], rows[2 * i + 1][1]), 2 * i + 1 not in kept) for i in range(150)]
    near, far = [x for j, x in got if j >= 0.85], [x for j, x in got if j < 0.7]
    assert len(near) > 30 and np.mean(near) >= 0.9 and len(far) > 20 and np.mean(far) <= 0.02


def near_rows(n, words, shares, seed):
    """Texts and copies of them with a share of their words changed: (2 i, text), (2 i + 1, copy)."""
    import random

    r = random.Random(seed)
    rows, vocabulary = [], [f"w{k}" for k in range(500)]
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(*words))]
        rows.append((2 * i, " ".join(w)))
        for k in r.sample(range(len(w)), max(1, int(len(w) * r.choice(shares)))):
            w[k] = "x" + w[k]
        rows.append((2 * i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [2, 1000])
def test_near_copies_go_just_if_they_are_as_alike_as_asked(spark, tile, monkeypatch):
    """Pairs on either side of 0.8 and close to it, short ones too; broadcast or not."""
    monkeypatch.setattr(simhash, "BROADCAST", 0 if tile == 2 else 1000)
    rows = near_rows(300, (60, 400), [0.01, 0.015, 0.02, 0.025, 0.03], 12) + [(i + 1000, t) for i, t in near_rows(100, (8, 40), [0.02], 13)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    degree = [alike(rows[k][1], rows[k + 1][1]) for k in range(0, len(rows), 2)]
    assert sum(0.75 <= j < 0.8 for j in degree) > 20 and sum(0.8 <= j < 0.85 for j in degree) > 20
    assert kept == {rows[k][0] for k in range(0, len(rows), 2)} | {rows[2 * k + 1][0] for k, j in enumerate(degree) if j < 0.8}


def test_unlike_texts_do_not_meet(spark):
    """Work of the near-duplicates stage: sets that share no band go to no tile, in a group of many each goes once."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t) for i, t in near_rows(200, (100, 200), [0.3], 14)], "doc_id long, text string").withColumn("_row", F.col("doc_id"))
    prints = simhash.banded(docs, "_row", 5).cache()
    assert prints.select("doc_id", F.explode("bands").alias("b")).groupBy("b").count().where("count > 1").count() < 20
    assert simhash.alike_links(docs, prints, "_row", 5, 8, 0.8).count() == 0
    prints.unpersist()


def test_components_of_long_paths_and_stars(spark):
    import random

    ids = list(range(400))
    random.Random(1).shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(199)] + [(ids[200], x) for x in ids[201:350]] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[x] for x in ids[:200]} == {min(ids[:200])} and {got[x] for x in ids[200:350]} == {min(ids[200:350])}


def words_removed(rows, window):
    seen, out = set(), []
    for i, t in ordered([r[:2] for r in rows]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        kept = [a for a, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "size"), [(20, 4 << 20), (20, 900), (4, 500)])
def test_substrings_are_exact(odd, odd_rows, window, size, monkeypatch):
    monkeypatch.setattr(packs.pack, "__defaults__", (size,))
    got = Counter(map(tuple, substrings.dedup(odd, window).collect()))
    assert got == words_removed(odd_rows, window) and sum(r[2] for r in got) > 0


def bytes_removed(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "gram", "step", "size"), [(400, 32, 32, 2 << 20), (400, 32, 32, 700), (40, 8, 4, 500), (30, 6, 8, 2 << 20)])
def test_suffixes_are_exact(odd, odd_rows, length, gram, step, size):
    got = Counter(map(tuple, suffixes.dedup(odd, length, gram, step, size).collect()))
    assert got == bytes_removed(odd_rows, length) and sum(r[2] for r in got) > 0


def test_repeats_that_settle_at_unlike_levels(spark):
    """Copies settle early; a third text that shares a part of them must still find it."""
    import random

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a = text(3000)
    rows = [(1, a), (2, a), (3, text(500) + a[700:1300] + text(900)), (4, a[:1500] + text(4) + a[1500:]), (5, text(1000)), (6, a[701:1101]), (7, a[2700:] + a[:150])]
    rows += [(10 + k, text(300) + a[1000:1000 + 395 + k] + text(300)) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, suffixes.dedup(docs, size=3500).collect())) == bytes_removed(rows, 400)


def test_windows_of_nothing(none):
    assert substrings.dedup(none).collect() == [] and suffixes.dedup(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_keys_survive_packing(values):
    keys = np.unique(np.array(values, np.uint64))
    assert (packs.unpack_keys(packs.pack_keys(keys)) == keys).all()
    at = packs.split(keys, 64, 7)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1c ß", max_size=30)), min_size=1, max_size=8))
def test_words_are_those_of_the_contract(texts):
    import re

    raw = [None if t is None else t.encode() for t in texts]
    sizes = np.array([-1 if x is None else len(x) for x in raw], np.int64).tobytes()
    p = packs.Pack(list(range(len(raw))), sizes, packs.squeeze(b"".join(x or b"" for x in raw)))
    s, e, d = p.words()
    got = [(k, p.raw[a:b].decode()) for a, b, k in zip(s.tolist(), e.tolist(), d.tolist(), strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def bandless(seed, words=404, changes=8):
    """A text and a copy of it with a Jaccard coefficient of 0.8 at least whose sketches share no band: changed where most bands break."""
    import random

    r = random.Random(seed)
    w = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    bands_of = lambda x: simhash.bands(simhash.sketches([simhash.shingle_set(" ".join(x).encode(), 5)]))[0][0]
    own, copy = bands_of(w), list(w)
    for n in range(changes):
        tries = [(j, f"x{n}{k}") for j in r.sample(range(5, words - 5), 40) for k in range(5) if all(v[0] != "x" for v in copy[j - 5 : j + 6])]
        j, v = min(tries, key=lambda t: int((bands_of([*copy[: t[0]], t[1], *copy[t[0] + 1 :]]) == own).sum()))
        copy[j] = v
        if not (bands_of(copy) == own).any():
            break
    return " ".join(w), " ".join(copy), int((bands_of(copy) == own).sum())


def test_links_without_a_common_band_are_found(spark):
    """What sketches miss: the pair goes into one component, whatever stands between; a common line doesn't hide it."""
    pairs = [bandless(seed) for seed in (1, 2, 3)]
    assert all(alike(a, b) >= 0.8 for a, b, _ in pairs) and sum(not n for *_, n in pairs) >= 2
    line = " said on every page of the site before anything else is said at all"
    rows = [(10 * k + i, t + line) for k, (a, b, _) in enumerate(pairs) for i, t in enumerate((a, b))]
    rows += [(10 * k + 5, t) for k, (a, *_) in enumerate(pairs) for t in (a, a)] + [(1000 + i, t + line) for i, t in near_rows(40, (30, 60), [0.3], 15)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == {i for i, _ in rows} - {1, 5, 11, 15, 21, 25}


@pytest.mark.parametrize("one", [True, False])
def test_forest_holds_all_links(one):
    """Against all pairs, at and around 0.8 exactly, sets from one to thousands of shingles, with components that are known."""
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 4, 5, 9, 10, 45, 90, 500, 6000)]
    sets += [x[: len(x) * 4 // 5] for x in sets if len(x) > 4] + [x[len(x) // 10 :] for x in sets[4:9]] + [x[: len(x) * 79 // 100] for x in sets[5:9]]
    side, of = np.arange(len(sets)) % (1 if one else 2), np.arange(len(sets)) * 7
    of[3] = of[4] = 5
    a, b = simhash.alike_forest(sets, side, of, 0.8)
    label = dict(enumerate(of.tolist()))

    def union(x, y):
        low, high = sorted((label[x], label[y]))
        label.update({k: low for k, v in label.items() if v == high})

    for x in range(len(sets)):
        for y in range(x):
            if (one or side[x] != side[y]) and 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y])):
                union(x, y)
    want, label = label, dict(enumerate(of.tolist()))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        union(x, y)
    assert label == want and len(set(want.values())) < len(sets) - 5


def test_prefixes_share_a_shingle_if_sets_are_alike():
    r = np.random.default_rng(5)
    vocabulary = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    often, place = vocabulary[::7], r.permutation(len(vocabulary[::7]))
    for _ in range(200):
        x = np.sort(r.choice(vocabulary, r.integers(1, 60), replace=False))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.choice(vocabulary, 2)]))
        h, of = simhash.prefix_of([x, np.empty(0, np.uint64), y], often, place, 0.8)
        assert len(h[of == 0]) == len(x) - -(-4 * len(x) // 5) + 1 and not (of == 1).any()
        if simhash.jaccard(x, y) >= 0.8:
            assert len(np.intersect1d(h[of == 0], h[of == 2]))
