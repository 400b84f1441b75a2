"""Quality rules, fill-in-middle and alignment, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tesserae.llm import alignment, fim, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(sql, **frames):
    c = duckdb.connect()
    for name, df in frames.items():
        c.register(name, df.toPandas().convert_dtypes())
    return Counter(c.sql(sql).fetchall())


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def noisy(spark, odd):
    """odd, with repeated lines, junk, many alphabets, markers and a long text."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ka", "ло", "ß", "日本", "é", "👩‍🚀", "x"]) for _ in range(r.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(12))
    same = line()
    texts = [
        "\n".join([same, line(), same, line(), same]), "In. " * 40, "buy now " * 30, f"{same}\n\n \n{same}", "# * $ % & | < > " * 4, "only nineteen words " * 6, " ".join(f"five of the same words{k // 9} x{k}" for k in range(30)), " ".join(word() for _ in range(400)), "a\x00b \x85   c d " * 9,
        "text with <P> inside", "<M>", "<S", "<", "<<P<S<M", "<|endoftext|> is <s> plain </s> <0x41> ▁ text", "tabs\tand  two   spaces \n\n ends ", "﻿bom", "é", "👩‍🚀", " ", "  ",
        " ".join(word() for _ in range(60_000)), "y" * 200_000, (line() + "\n") * 2_000,
    ]
    more = spark.createDataFrame([(1000 + k, x, None, None, None) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return odd.unionByName(more, allowMissingColumns=True)


# Quality.


def plain_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(x)))
        seen.add(x)
    covered = {}
    for n in range(5, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, inside = Counter(grams), bytearray(len(words))
        for i, g in enumerate(grams):
            if count[g] > 1:
                inside[i : i + n] = b"\1" * n
        covered[n] = (sum(len(w) for w, x in zip(words, inside, strict=True) if x), sum(inside))
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * covered[8][1] > 30 * len(words)
    kept = not failed and dup_chars <= quality.LINE_LIMIT * chars and all(covered[n][0] <= quality.LIMITS[n] * chars for n in covered)
    return (len(words), chars, sum((text or "").count(x) for x in "#*$%&|<>"), dup, covered[8][1], failed, kept, dup_chars, *(covered[n][0] for n in sorted(covered)))


def test_quality_against_a_plain_version(noisy):
    want = Counter((r.doc_id, *plain_quality(r.text)) for r in noisy.collect())
    got = rows_of(quality.judged(noisy))
    assert got == want
    assert {True, False} == {k[7] for k in got} and any(not k[6] and not k[7] for k in got)


def test_quality_matches_sql(odd):
    assert rows_of(quality.judged(odd)) == duck(quality.SQL, documents=odd.select("doc_id", "text"))


def test_keep_good(odd, none):
    got = quality.keep_good(odd)
    kept = Counter(r.doc_id for r in quality.judged(odd).where("kept").collect())
    assert got.columns == odd.columns and Counter(r.doc_id for r in got.collect()) == kept and sum(kept.values()) > 30
    assert quality.judged(none).collect() == [] and quality.keep_good(none).collect() == []


def test_clean_texts_are_kept(spark):
    """A line said twice in a text of ordinary length isn't repetition; a word said over and over is."""
    r = random.Random(1)
    fresh = lambda n: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))
    line = fresh(10)
    texts = [fresh(80), f"{line}\n{fresh(70)}\n{line}", fresh(40) + " spam" * 60, "\n".join([line] * 9), fresh(19), fresh(20)]
    got = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.kept for x in got] == [True, True, False, False, False, True]


def test_collisions_do_not_count():
    r = random.Random(2)
    raws = [" ".join(r.choice("abcd") for _ in range(60)).encode() for _ in range(8)]
    want = quality.measures(raws)
    few = quality.measures(raws, hashed=lambda ids: np.zeros(len(ids), np.uint64))  # every window collides
    assert all((x == y).all() for x, y in zip(want, few, strict=True))


def test_limits_are_parameters(odd):
    strict = quality.judged(odd, limits={3: 0.0, 6: 0.0}, line_limit=0.0, least=5)
    assert strict.columns[-2:] == ["dup_chars_3", "dup_chars_6"]
    assert all(not r.kept or r.dup_chars_3 == r.dup_chars_6 == r.dup_line_chars == 0 for r in strict.collect())


# Fill-in-middle.


def plain_fim(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), None, None
    form = "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:i], text[i:j], text[j:]
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, i, j - i, sha(out), sha(text), len(p.encode()), len(m.encode())


def test_fim_against_a_plain_version(noisy):
    rows = noisy.collect()
    got = rows_of(fim.formed(noisy))
    assert got == Counter(plain_fim(r.doc_id, r.text) for r in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_fim_matches_sql(odd):
    assert rows_of(fim.formed(odd)) == duck(fim.SQL, documents=odd.select("doc_id", "text"))


def test_round_trip_with_other_markers(noisy, none):
    marks = ("[pre", ".*", "mid]")
    out = fim.transform(noisy, to="made", salt="x", markers=marks, formed=100)
    assert out.columns == [*noisy.columns, "made"]
    back = out.select("text", fim.restore(out.made.output, out.made.form, marks).alias("back"), "made.form").collect()
    assert all(r.back == (r.text or "") for r in back) and sum(r.form != "plain" for r in back) > 90
    assert fim.formed(none).collect() == []


def test_sparse_index():
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice("ab é日👩́") for _ in range(r.randint(0, 30)))
        index, points = fim.exceptions(text.encode()), np.arange(len(text) + 1)
        starts = np.array([len(text[:k].encode()) for k in points])
        assert (index.to_byte(points) == starts).all() and (index.to_point(starts) == points).all()
        assert len(index.points) == sum(len(c.encode()) > 1 for c in text)
    assert fim.exceptions(b"\x80\x80a\xc3\xa9").to_byte(np.arange(5)).tolist() == [0, 1, 2, 3, 5]


# Alignment.


@pytest.fixture(scope="module")
def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    of = alignment.unicode_bytes()
    spell = {i: bytes(of[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    byte = re.compile("<0x(..)>")
    piece = lambda i: bytes([int(m[1], 16)]) if (m := byte.fullmatch(b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb, yb, raw = [spell[i] for i in x], [piece(i) for i in y], (" " + text).encode()
        return (list(zip(x, xb, strict=True)), list(zip(y, yb, strict=True))) if b"".join(xb) == raw == b"".join(yb) else None

    return encode


def plain_alignment(texts, encode):
    per, count = [], Counter()
    for text in texts:
        got = encode(text)
        if got is None:
            per.append(None)
            continue
        x, y = got
        spans = []
        for side in got:
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        links, i, j = [], 0, 0
        while i < len(spans[0]) and j < len(spans[1]):
            links.append((spans[0][i][2], spans[1][j][2]))
            e, f = spans[0][i][1], spans[1][j][1]
            i, j = i + (e <= f), j + (f <= e)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for end in common:
            ga, gb = [], []
            while i < len(spans[0]) and spans[0][i][1] <= end:
                ga.append(str(spans[0][i][2]))
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= end:
                gb.append(str(spans[1][j][2]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        per.append((len(x), len(y), groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    measured = [
        (0, 0, 0, 0, 0, 0, "") if v is None else (v[0], v[1], len(v[2]), len(v[3]), sum(count[k] == best[k[0]] for k in v[3]), sum(count[k] for k in v[3]), sha(";".join(v[2])))
        for v in per
    ]
    return measured, count


@pytest.mark.parametrize("most", [alignment.MOST, 0])
def test_alignment_against_a_plain_version(noisy, plain_tokenizers, most):
    rows = noisy.select("doc_id", "text").collect()
    want, count = plain_alignment([r.text for r in rows], plain_tokenizers)
    got, counts = alignment.alignment(noisy, most=most)
    assert rows_of(alignment.align(noisy, most=most)) == Counter((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert {(r.a, r.b): r.n for r in counts.collect()} == count
    assert any(w[0] == 0 and r.text for r, w in zip(rows, want, strict=True)), "a text whose bytes differ"
    assert got.columns == ["doc_id", "row", *alignment.MEASURES, "groups"]


def test_alignment_of_small_chunks_and_trees(odd, monkeypatch):
    """Many flushes of a task, and many levels of the tree, change nothing."""
    want = rows_of(alignment.align(odd))
    assert sum(want.values()) == odd.count()
    monkeypatch.setattr(alignment, "FAN", 2)
    assert rows_of(alignment.align(odd.repartition(9))) == want


def test_alignment_of_nothing(none, spark):
    assert alignment.align(none).collect() == []
    got = alignment.align(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string"))
    assert rows_of(got) == Counter({(None, 0, 0, 0, 0, 0, 0, ""): 1, (1, 0, 0, 0, 0, 0, 0, ""): 2})


def test_words_are_encoded_as_in_whole_texts():
    with open(alignment.B_FILE, "rb") as f:
        raw = f.read()
    by_word, whole = alignment.PieceBPE(raw), alignment.PieceBPE(raw)
    assert by_word.by_word
    whole.by_word = False
    r = random.Random(7)
    texts = ["".join(r.choice(["ab", " ", "  ", "ü", "\n", "the", "日", "1", ".", "▁"]) for _ in range(r.randint(1, 40))) for _ in range(500)]
    for x, y in zip(by_word.encode(texts), whole.encode(texts), strict=True):
        assert (x is None) == (y is None) and (x is None or x.tolist() == y.tolist())


@pytest.mark.parametrize("n", [0, 1, 63, 5_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    for mph in (alignment.PerfectHash(keys), alignment.PerfectHash.unpacked(alignment.PerfectHash(keys).packed())):
        assert sorted(mph.numbers(keys)) == list(range(len(keys))) == list(range(mph.n))
        assert mph.numbers(keys + (1 << 41)).max(initial=-1) < max(1, mph.n)


def test_perfect_hash_with_a_rest(monkeypatch):
    monkeypatch.setattr(alignment, "LEVELS", 1)
    keys = np.arange(2_000) * 7
    mph = alignment.PerfectHash(keys)
    assert len(mph.rest) > 100 and sorted(mph.numbers(keys)) == list(range(2_000))
    assert sorted(alignment.PerfectHash.unpacked(mph.packed()).numbers(keys)) == list(range(2_000))
