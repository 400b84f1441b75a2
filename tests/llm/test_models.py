"""Katz scoring against a plain restatement; language ID and toxicity by held-out accuracy; top-k against numpy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import katz, langid, packs, search, toxicity


def katz_scores(rows):
    def split(t):
        return (t or "").encode().lower().split() + ["end"]

    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    one, two = Counter(), Counter()
    for i, t, *_ in rows:
        if not out[i]:
            w = split(t)
            one.update(w)
            two.update(zip(["begin", *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.discounts([0, *(Counter(c.values())[k] for k in range(1, 7))]) for c in (one, two))
    cut = lambda c, d: d[c] * c if c <= 5 else c
    freed = 1 - sum(cut(c, d1) for c in one.values()) / n
    unknown = max(freed, 1 / (n + 1))

    def p(w):
        return cut(one[w], d1) / n * (1 - unknown) / (1 - freed) if w in one else unknown

    after = defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))
    total = {h: sum(c for _, c in x) for h, x in after.items()}
    share = {h: sum(cut(c, d2) for _, c in x) / total[h] for h, x in after.items()}
    scale = {h: min(1, total[h] / (total[h] + 1) / share[h]) for h in after}
    alpha = {h: (1 - share[h] * scale[h]) / (1 - sum(p(w) for w, _ in x)) for h, x in after.items()}

    def q(h, w):
        c = two[(h, w)]
        return cut(c, d2) * scale[h] / total[h] if c else alpha.get(h, 1) * p(w)

    for h in list(after)[:20]:
        assert abs(sum(q(h, w) for w in one) + alpha[h] * unknown - 1) < 1e-9
    got = []
    for i, t, *_ in rows:
        w = split(t)
        got.append((i, out[i], len(w), sum(x in one for x in w), n, round(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), 5), round(sum(math.log10(q(h, x)) for h, x in zip(["begin", *w[:-1]], w, strict=True)), 5)))
    return got


@pytest.mark.parametrize("size", [8 << 20, 600])
def test_katz_scores(odd, odd_rows, size):
    got = [(*tuple(r)[:5], round(r[5], 5), round(r[6], 5)) for r in katz.score(odd, size=size).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    want = katz_scores(odd_rows)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=1e-4)


def test_katz_without_training_text(spark, none):
    assert katz.score(none).collect() == []
    i = next(i for i in range(100) if katz.held_out(i))
    assert [(r.n_known, r.train_tokens, r.score) for r in katz.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()] == [(0, 0, 0.0)]


def test_discounts_fall_back():
    assert (katz.discounts([0, 0, 0, 0, 0, 0, 0])[1:] < 1).all()
    assert katz.discounts([0, 100, 40, 20, 12, 8, 5])[1] == pytest.approx((2 * 40 / 100 - 0.3) / 0.7)


@pytest.mark.parametrize("n", [[0, 207344, 59772, 25017, 14274, 13493, 7080], [0, 1579638, 246704, 51653, 21705, 18939, 7580], [0, 500, 90, 0, 20, 40, 3]])
def test_ragged_discounts_stay_good_turing(n):
    d, m = katz.discounts(n)[1:], katz.smoothed(np.array(n, float))
    assert ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all()
    cut = 6 * m[6] / m[1]
    assert d == pytest.approx([((c + 1) * m[c + 1] / (c * m[c]) - cut) / (1 - cut) for c in range(1, 6)])


def sentences(lang, n, r):
    parts = {"en": ["the", "ing", "tion", "and", "er"], "de": ["ung", "sch", "ein", "keit", "der"], "fr": ["eux", "ier", "que", "ment", "ou"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language_held_out(spark):
    r = random.Random(2)
    rows = [(i, sentences(x, r.randint(2, 60), r), x) for i, x in enumerate(["en", "de", "fr"] * 120)]
    rows += [(900, None, "en"), (901, "12 !!", "de"), (902, "", None), (None, sentences("fr", 30, r), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, ~langid.held_out(docs))
    assert list(content) == ["de", "en", "fr"]
    got = [(x.lang, x.lang_pred, x.score, x.doc_id) for x in langid.identify(docs, content).join(docs, "doc_id", "left").collect()]
    seen = [(a, b) for a, b, _, i in got if i is not None and i < 900]
    assert np.mean([a == b for a, b in seen]) > 0.98
    assert {i: (b, s) for _, b, s, i in got if i is not None and i >= 900} == {900: ("und", 0.0), 901: ("und", 0.0), 902: ("und", 0.0)}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and 350 <= kept.count() <= 361


def test_language_of_short_texts_only(spark):
    """A language whose labelled texts are all short is learned as well, and texts of any length are judged by one rule."""
    r = random.Random(8)
    rows = [(i, sentences(x, 2 if x == "fr" else 40, r)[:18], x) for i, x in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, F.lit(True))
    assert list(content) == ["de", "en", "fr"]
    assert len(langid.probe("ab " * 400)) == langid.TIMES * len(langid.words("ab"))


def test_language_against_a_plain_restatement(spark):
    import zstandard

    r = random.Random(9)
    rows = [(i, sentences(x, r.randint(1, 60), r) if i % 11 else None, x) for i, x in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.dictionaries(docs, ~langid.held_out(docs))
    got = {x.doc_id: (x.lang_pred, x.score, x.rejected) for x in langid.identify(docs, content).collect()}
    for i, t, _ in rows:
        seen = dict.fromkeys("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        if not seen:
            assert got[i] == ("und", 0.0, True)
            continue
        raw = (" " + " ".join(seen) + " ").encode() * 8
        sizes = []
        for name, x in content.items():
            tune = zstandard.ZstdCompressionParameters.from_level(5, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
            sizes.append((len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=tune).compress(raw)), name))
        (a, best), (b, _), *_ = sorted(sizes)
        assert got[i] == (best, pytest.approx((b - a) / b), (b - a) / b < langid.MARGIN)


def test_language_without_training(spark, none):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs, {}).collect()] == [("und", 0.0, True)]
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, {"en": b" word some "}).collect()] == [("en", 1.0)]
    assert langid.dictionaries(none, F.lit(True)) == {} and langid.identify(none, {}).collect() == []


def test_toxicity_held_out(spark, none):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic, low = int(r.random() < 0.2), int(r.random() < 0.3)
        words = sentences("en", 40, r).split() + ["scum", "idiotic"] * toxic + ["spam"] * low
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, low, toxic if i % 50 else None))
    docs, marks = spark.createDataFrame(rows + [(None, None), (700, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(docs, marks.where("doc_id < 400"))
    got = {x.doc_id: (x.p_low_quality, x.p_toxic) for x in toxicity.score(docs, chain).collect()}
    assert len(got) == 602 and all(0 <= v <= 1 for x in got.values() for v in x)
    assert np.mean([(got[i][1] >= 0.5) == bool(t) for i, _, t in labels if i >= 400 and t is not None]) > 0.97
    empty = toxicity.fit(none, marks)
    assert toxicity.score(none, empty).collect() == [] and len(toxicity.score(docs, empty).collect()) == 602


def vectors(spark, n, dims, seed=0):
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(g.normal(size=dims), 1)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None]), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (None, [1.0] * dims), (n + 4, []), (n + 5, [2.0]), (n + 6, [9.0] * (dims + 2)), (5, [4.0] * dims), (20, [3.0] * dims), (20, [-9.0] * dims), (30, rows[30][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("rows", "queries"), [(4096, 1024), (30, 2)])
def test_top_k(spark, rows, queries):
    data, df = vectors(spark, 120, 6)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want, least = Counter(), {}
    for k, (q, v) in enumerate(good):
        if q % 10 == 0 and (q not in least or v < good[least[q]][1]):
            least[q] = k
    for q, at in least.items():
        scores = sorted((-sum(a * b for a, b in zip(good[at][1], w, strict=False)), i) for k, (i, w) in enumerate(good) if k != at)[:10]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scores))
    assert Counter(tuple(r) for r in search.top_k(df, F.col("vec_id") % 10 == 0, rows=rows, queries=queries).collect()) == want


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_spans_hash_equal_stretches_alike():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    sums = packs.prefix(raw.astype(np.uint64))
    h = packs.span(sums, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_thue_morse_words_hash_apart():
    """Of these, a polynomial modulo 2^64 can't tell one from its complement, whatever its odd base."""
    bits = np.array([bin(k).count("1") % 2 for k in range(2048)], np.uint8)
    raw = np.concatenate([bits, 1 - bits]) + np.uint8(97)
    sums = packs.prefix(raw)
    at = np.array([0, 2048])
    assert packs.rough(sums, at, at + 2048)[0] == packs.rough(sums, at, at + 2048)[1]
    assert packs.span(sums, at, at + 2048)[0] != packs.span(sums, at, at + 2048)[1]
    wide = np.random.default_rng(0).integers(0, 2**64, 200_000, np.uint64)
    wide[150_000:150_100] = wide[10:110]
    h = packs.span(packs.prefix(wide), np.array([10, 150_000, 150_001]), np.array([110, 150_100, 150_101]))
    assert h[0] == h[1] != h[2]


def test_short_words_hash_apart():
    raw = np.arange(256, dtype=np.uint8)
    at = np.arange(255)
    h = np.concatenate([packs.span(packs.prefix(raw, 1), at, at + 1), packs.span(packs.prefix(raw, 1), at[:-1], at[:-1] + 2)])
    assert len(np.unique(h)) == len(h)


def test_counts_over_32_bits_survive():
    many = np.array([3, 2**32 + 5, 2**40], np.int64)
    assert (packs.unplanes(packs.planes(many), np.int64) == many).all()
    uni = katz.Unigrams(2**41, 3, katz.discounts([0] * 7), 1.0, 1e-9)
    assert uni.p(many)[2] == pytest.approx(0.5) and uni.p(many)[1] > uni.p(many)[0]


def test_chain_against_a_plain_restatement():
    """Of given terms: each fold's logits come from a model that saw neither its rows nor its terms."""
    g = np.random.default_rng(3)
    x = (g.random((200, 6)) < 0.3).astype(float)
    y = np.stack([(x[:, 0] + x[:, 1] + g.random(200) > 1).astype(float), (x[:, 2] + g.random(200) > 0.9).astype(float)], axis=1)
    part, index = np.arange(200) % 5, {f"t{k}": k for k in range(6)}
    inside = np.ones((6, 6), bool)
    inside[0, 5] = inside[2, 0] = False
    terms, weights = toxicity.chain(x, y, part, inside, index)
    assert terms == {f"t{k}": k for k in range(5)} and [len(w) for w in weights] == [6, 7]
    assert weights[0] == pytest.approx(toxicity.logistic(x[:, :5], y[:, 0]))
    unseen = np.zeros(200)
    for f in range(5):
        own = x[:, inside[f + 1]]
        w = toxicity.logistic(own[part != f], y[part != f, 0])
        unseen[part == f] = own[part == f] @ w[:-1] + w[-1]
    assert weights[1] == pytest.approx(toxicity.logistic(np.hstack([x[:, :5], unseen[:, None]]), y[:, 1]))


def test_toxicity_scores_against_a_plain_restatement(spark):
    chain = toxicity.Chain(("low_quality", "toxic"), {"bad": 0, "spam": 1, "idio*": 2}, [np.array([0.5, 2.0, 0.1, -1.0]), np.array([3.0, 0.2, 2.5, 0.7, -2.0])])
    rows = [(1, "Bad spam"), (2, "idiotic"), (3, None), (None, "good"), (5, "bad " * 9000)]
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    for i, t in rows:
        f = [float("bad" in (t or "").lower()), float("spam" in (t or "").lower()), float("idiotic" in (t or ""))]
        a = 0.5 * f[0] + 2.0 * f[1] + 0.1 * f[2] - 1
        b = 3.0 * f[0] + 0.2 * f[1] + 2.5 * f[2] + 0.7 * a - 2
        assert got[i] == pytest.approx((1 / (1 + math.exp(-a)), 1 / (1 + math.exp(-b))))
