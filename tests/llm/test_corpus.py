"""Decontamination, mixing, sharding and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tesserae.llm import decontam, mixing, sharding


def duck(sql, **frames):
    c = duckdb.connect()
    for name, df in frames.items():
        c.register(name, df.toPandas().convert_dtypes())
    return Counter(c.sql(sql).fetchall())


def rows_of(df):
    return Counter(map(tuple, df.collect()))


ITEM = "On Monday early Alice quietly bought about 12 kg of red apples for 30 euros and gave Alice half of them to the hungry children nearby"


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(1)
    noise = lambda: " ".join(r.choice(["stone", "river", "walks", "bright", "under", "green", "seven", "moon"]) for _ in range(60))
    other = ITEM.replace("Alice", "Bob").replace("12", "77").replace("30", "45").replace("euros", "dollars").replace("Monday", "Friday")
    torn = ITEM.replace("about 12", "about 15").replace("gave Alice", "gave Carol")
    docs = [(1, noise()), (2, noise() + " " + ITEM + " " + noise()), (3, noise() + "\n" + other), (4, torn), (5, None), (6, ""), (7, ITEM.split("red")[0]), (2, noise()), (None, ITEM), (8, ITEM.lower().replace("monday", "Monday").replace("alice", "Alice").upper())]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, ITEM), (1, "too short"), (2, None), (3, noise())], "item_id long, text string")


def test_leaks_match_sql(leaky):
    docs, bench = leaky
    assert rows_of(decontam.leaks(docs, bench)) == duck(decontam.SQL, documents=docs, benchmark=bench)
    more = docs.union(docs.sparkSession.createDataFrame([(20, "so 10 20 30 40 50 60 70 80 90 it is Too short"), (21, ITEM.lower()), (22, ITEM.replace("30", "31").replace("Alice", "Eve"))], docs.schema))
    hard = bench.union(docs.sparkSession.createDataFrame([(10, "10 20 30 40 50 60 70 80 90"), (11, ITEM.upper()), (12, "a"), (0, ITEM)], bench.schema))
    got = rows_of(decontam.leaks(more, hard))
    assert got == duck(decontam.SQL, documents=more, benchmark=hard)
    assert {(20, 10), (21, 0), (21, 11), (22, 0)} <= {r[:2] for r in got}


def test_clean_documents_are_kept(leaky, none, odd):
    docs, bench = leaky
    assert Counter(r.doc_id for r in decontam.keep_clean(docs, bench).collect()) == Counter([1, 4, 5, 6, 7])
    assert decontam.leaks(none, bench).collect() == [] and decontam.leaks(docs, bench.limit(0)).collect() == []
    assert decontam.keep_clean(odd, bench).count() == odd.count()


@pytest.mark.parametrize("most", [500_000, 0])
def test_verbatim_copies_are_leaks_in_any_case(leaky, spark, most):
    docs, bench = leaky
    got = {(r.doc_id, r.item_id): r.reworded for r in decontam.leaks(docs, bench, most=most).collect()}
    assert got == {(2, 0): False, (3, 0): True, (None, 0): False, (8, 0): False}
    shouted = spark.createDataFrame([(0, ITEM.upper()), (1, "10 20 30 40 50 60 70 80 90")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(9, "so 10 20 30 40 50 60 70 80 90"), (10, "10 20 30 41 50 60 71 80 90")], docs.schema))
    assert {(r.doc_id, r.item_id, r.coverage) for r in decontam.leaks(more, shouted, most=most).collect()} == {(2, 0, 1.0), (None, 0, 1.0), (8, 0, 1.0), (9, 1, 1.0)}


def test_leaks_in_a_text_of_many_windows(leaky, spark):
    """20,000 tokens, an item in their midst and one at their end, and a window that repeats throughout; twice under one id."""
    r = random.Random(5)
    filler = [r.choice(["stone", "Rome", "12", "kg", "green"]) + str(r.randint(0, 99)) * r.randint(0, 1) for _ in range(9_000)] + ["over and over again he"] * 400
    text = " ".join(filler[:5_000]) + " " + ITEM + " " + " ".join(filler[5_000:]) + " " + ITEM.replace("30", "31").upper()
    docs = spark.createDataFrame([(1, text), (1, text), (2, text.lower()), (3, " ".join(filler))], "doc_id long, text string")
    bench = leaky[1].union(spark.createDataFrame([(7, "over and over again he over and over again")], leaky[1].schema))
    got = rows_of(decontam.leaks(docs, bench))
    assert {r[:2] for r in got} == {(1, 0), (1, 7), (2, 0), (2, 7), (3, 7)}
    assert got == rows_of(decontam.leaks(docs, bench, most=0, most_bytes=0))


def test_pipeline_drops_shouted_copies(leaky, spark, tmp_path):
    leaky[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(r.doc_id for r in corpus_pipeline.decontaminate(spark, leaky[0], str(tmp_path)).collect()) == Counter([1, 4, 5, 6, 7])


def test_an_inconsistent_slot_takes_its_windows_only(spark, tmp_path):
    item = "The old ferry left its pier at dawn and slowly crossed the wide grey bay before it met the fog. The crew rang a bell for an hour while the gulls kept circling above their small deck and begging for any bread"
    docs = [(1, item.replace("fog. The", "fog. A")), (2, item.replace("fog. The", "fog. One").replace("The old", "An old")), (3, " ".join(item.split()[:20]) + " One crew slept")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")
    n = len(item.split()) - 4
    got = {r.doc_id: (r.matched, r.windows) for r in decontam.leaks(docs, bench).collect()}
    assert got == {1: (n, n), 2: (n - 6, n)}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [3]


def test_mix_matches_sql(odd):
    got = Counter((r.doc_id, r["size"], r.source, r.source_size, round(r.target, 6), r.taken, r.copies, round(r.position, 6)) for r in mixing.mix(odd).collect())
    want = Counter((r[0], r[1], r[2], r[3], round(r[4], 6), r[5], r[6], round(r[7], 6)) for r in duck(mixing.SQL, documents=odd.select("doc_id", "text", "source")).elements())
    assert got == want


def test_mix_takes_its_targets(odd, odd_rows):
    rows = mixing.mix(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"] and 0 <= r.position <= 1
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= 1 and x[0].target <= 3 * x[0].source_size
    assert abs(sum(x[0].target for x in by.values()) - sum(r["size"] for r in rows)) < 1e-6 and len(rows) == len(odd_rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert mixing.mix(odd.coalesce(1)).collect() == rows


def test_more_cells_change_nothing(odd, monkeypatch):
    want = [rows_of(mixing.mix(odd, u)) for u in ("words", "documents")]
    monkeypatch.setattr(mixing, "CELL_ROWS", 0.001)
    assert [rows_of(mixing.mix(odd, u)) for u in ("words", "documents")] == want


def test_mix_of_nothing(none, spark):
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_documents_are_whole(odd):
    copies = Counter()
    for r in mixing.mix(odd, "documents").collect():
        copies[r.doc_id, r["size"]] += r.copies
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    found = got.collect()
    assert all((r.doc_id, r.text) in texts for r in found)
    unique = [k for k in copies if k[0] not in (305,)]
    assert Counter(r.doc_id for r in found if r.doc_id != 305) == Counter({k[0]: copies[k] for k in unique if copies[k]})


@pytest.mark.parametrize("cell", [500, 5])
def test_shards(odd, odd_rows, cell, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    monkeypatch.setattr(sharding, "GRAIN", 4 if cell == 5 else 2048)
    rows = sharding.shard(odd, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    home, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        home[r["size"], r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(len(x) == 1 for x in home.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(Counter({k: n * k[0] for k, n in Counter((r["size"], r.text_crc32) for r in rows).items()}).values())
    assert max(size.values()) - min(size.values()) <= largest


def test_shards_of_nothing(none, odd):
    assert sharding.shard(none).collect() == []
    assert len({r.shard for r in sharding.shard(odd, capacity=40_000).collect()}) == 2


@pytest.mark.parametrize("cell", [500, 4])
def test_no_shard_is_over_its_capacity(spark, cell, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    monkeypatch.setattr(sharding, "GRAIN", 2)
    r = random.Random(2)
    rows = [(i, "x" * (r.choice([30, 55, 62, 91]) - len(str(i)) - 1) + str(i)) for i in range(60)] + [(99, "y" * 250)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), capacity=100).collect()
    size = Counter()
    for x in got:
        size[x.shard] += x["size"]
    assert len(got) == 61 and all(v <= 100 or (v == 251 and k == next(x.shard for x in got if x.doc_id == 99)) for k, v in size.items())
    assert sorted(size) == list(range(len(size))) or len(size) <= 61


def test_best_fit_opens_bins():
    room = [10]
    assert sharding.best_fit([8, 7, 3, 2], room, strict=True, capacity=10) == [0, 1, 1, 0] and room == [0, 0]
    assert sharding.best_fit([8, 7, 2], [10], strict=True) == [0, -1, 0]


def test_best_fit_against_a_plain_search():
    r = random.Random(0)
    for _ in range(200):
        room = [r.randint(0, 60) for _ in range(r.randint(1, 9))]
        sizes = sorted((r.randint(1, 30) for _ in range(r.randint(0, 25))), reverse=True)
        plain, want = list(room), []
        for s in sizes:
            fits = [(x, k) for k, x in enumerate(plain) if x >= s]
            k = min(fits)[1] if fits else max((x, k) for k, x in enumerate(plain))[1]
            plain[k] -= s
            want.append(k)
        assert sharding.best_fit(sizes, list(room)) == want


def test_pipeline(spark, odd, leaky, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    leaky[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shards"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = at.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
    got, again = rows_of(at), rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == again and sum(got.values()) > 10


def plain_targets(size):
    """Of the sizes of sources: weights 5, 2, 1 in turn, capped at three times a source's size, the excess reshared."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in names if s not in capped and free and weight[s] * rest / free > 3 * size[s]}
        if not over:
            return {s: 3.0 * size[s] if s in capped else weight[s] * rest / free for s in names}
        capped |= over


def test_each_stage_against_a_plain_version(spark, odd, odd_rows, leaky, tmp_path):
    """Language, near-duplicates, leaks, copies and shards, each worked out again from the rows its predecessor kept."""
    import hashlib
    import math
    import re

    import zstandard
    from pyspark.sql import functions as F

    from tesserae.llm import langid

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL AND doc_id <> 305").coalesce(1)
    docs = docs.unionByName(leaky[0].where("doc_id = 3").select((F.col("doc_id") + 900).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    leaky[1].write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    at = docs.collect()

    def run(name, rows):
        return stages[name](spark, spark.createDataFrame(rows, docs.schema), str(tmp_path)).collect()

    content = langid.dictionaries(docs, F.lit(True))
    packers = langid.packers(content)

    def margin(text):
        seen = dict.fromkeys("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        if not seen:
            return -1.0
        a, b = sorted(len(p.compress((" " + " ".join(seen) + " ").encode() * 8)) for p in packers)[:2]
        return (b - a) / b

    assert zstandard and len(content) >= 2
    kept = run("language", at)
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in at if margin(r.text) >= langid.MARGIN)

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r.text) for r in kept]
    root = list(range(len(kept)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(kept):
        first[find(i)] = min(first.get(find(i), r.doc_id), r.doc_id)
    single = run("near_duplicates", kept)
    assert sorted(r.doc_id for r in single) == sorted(first.values())
    leaked = {r[0] for r in duck(decontam.SQL, documents=spark.createDataFrame(single, docs.schema), benchmark=leaky[1])}
    clean = run("decontaminate", single)
    assert leaked == {903} and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if r.doc_id not in leaked)

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean}
    held = Counter()
    for r in clean:
        held[r.source] += size[r.doc_id]
    target, want = plain_targets(held), Counter()
    for source in held:
        key = lambda r: (999 - math.floor(math.log2(size[r.doc_id] + 1) * 8), hashlib.md5(str(r.doc_id).encode()).hexdigest())
        rate = target[source] / held[source]
        for k, r in enumerate(sorted((r for r in clean if r.source == source), key=key)):
            want[r.doc_id] += math.floor(rate * (k + 1) + 0.5) - math.floor(rate * k + 0.5)
    mixed = run("mix", clean)
    assert Counter(r.doc_id for r in mixed) == +want
    got = run("shards", mixed)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, len(r.text.encode()) + 1) for r in mixed)
    assert all(len(x) == 1 for x in (lambda d: [d[r.text_crc32].add(r.shard) or d[r.text_crc32] for r in got])(defaultdict(set)))
