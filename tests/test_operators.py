"""Operators on small inputs: cases with known answers, properties and brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import paths, text
from tesserae.operators import assoc, changes, extract, graph, report, resolve, timewin, vote


def column(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("x"))).collect()]


def test_paths(spark):
    names = ["src/a/b.test.ts", "main.py", "lib/x.tar.gz", "tests/t.py", "pkg/foo_test.go", "examples/e.js", ".env"]
    assert column(spark, names, paths.dirname) == ["src/a", ".", "lib", "tests", "pkg", "examples", "."]
    assert column(spark, names, paths.basename) == ["b.test.ts", "main.py", "x.tar.gz", "t.py", "foo_test.go", "e.js", ".env"]
    assert column(spark, names, paths.extension) == [".ts", ".py", ".gz", ".py", ".go", ".js", ""]
    assert column(spark, names, paths.shorten)[:2] == ["src/…/b.test.ts", "main.py"]
    assert column(spark, names, paths.is_test) == [True, False, False, True, False, False, False]
    assert column(spark, names, paths.is_test_for_tasks)[4] and column(spark, names, paths.is_example)[5]
    assert column(spark, names, paths.language) == ["TypeScript", "Python", None, "Python", "Go", "JavaScript", None]


def test_texts(spark):
    code = 'a <!-- x\ny --> b /* c\nd */ e // f\ng """doc""" h'
    assert column(spark, [code, "see http://x.y"], text.strip_comments) == ['a  b  e \ng "" h', "see http:"]
    assert column(spark, ["camelCaseName"], text.snake_case) == ["camel_case_name"]
    assert column(spark, ["a–b “c” … é"], text.ascii_safe) == ['a-b "c" ... ?']
    assert column(spark, ["Fix the big bug in a parser"], lambda x: text.ngrams(text.words(x, stop=("the",)), 2)) == [["fix_big", "big_bug", "bug_parser"]]
    assert column(spark, ["feat(ui): x", "fix: y", "chore!: z", "misc"], text.commit_scope) == ["ui", "", "", None]
    assert column(spark, ["\n".join(map(str, range(30)))], text.preview) == ["\n".join(map(str, range(20)))]


def test_imports(spark):
    js = 'import a from "./a";\n/* import x from "./no" */\nexport { b } from \'../b\'; const c = require("@/c"); import("./d"); import z from "lib";'
    assert column(spark, [js], extract.script_imports) == [["./a", "../b", "./d", "@/c"]]
    assert column(spark, ["from .a import b\n  import os.path\nfrom x.y import z"], extract.python_imports) == [[".a", "x.y", "os.path"]]
    assert column(spark, ['import (\n "a/b"\n c "d"\n)\nimport "e"\n'], extract.go_imports) == [["a/b", "d", "e"]]
    assert column(spark, ["use crate::a::b; use super::c;\npub mod d;"], extract.rust_imports) == [["crate::a::b", "super::c", "mod::d"]]


def test_resolution_takes_the_first_candidate(spark):
    edges = spark.createDataFrame([("src/a/x.ts", "./y"), ("src/a/x.ts", "../z.js"), ("src/a/x.ts", "@/lib/q"), ("x.ts", "./none")], "src string, spec string")
    known = spark.createDataFrame([("src/a/y.tsx",), ("src/a/y/index.ts",), ("src/z.ts",), ("src/lib/q/index.js",)], "path string")
    got = resolve.script(edges, known)
    assert {(r.spec, r.dst) for r in got.collect()} == {("./y", "src/a/y.tsx"), ("../z.js", "src/z.ts"), ("@/lib/q", "src/lib/q/index.js")}


def test_cooccur_against_brute_force(spark):
    r = random.Random(1)
    rows = [(t, r.choice("abcdefg")) for t in range(40) for _ in range(r.randint(1, 6))] + [(99, x) for x in "abcdefghijklmnopqrstuvwxyz"] + [(None, "a"), (3, None)]
    baskets = defaultdict(set)
    for t, i in rows:
        if t is not None and i is not None:
            baskets[t].add(i)
    kept = [b for b in baskets.values() if 2 <= len(b) <= 20]
    one = Counter(i for b in kept for i in b)
    two = Counter(p for b in kept for p in itertools.combinations(sorted(b), 2))
    want = {(a, b, c, round(c / (one[a] + one[b] - c), 6)) for (a, b), c in two.items() if c >= 2 and c / (one[a] + one[b] - c) > 0.2}
    pairs = assoc.cooccur(spark.createDataFrame(rows, "t int, i string"), ["t"], "i")
    assert {tuple(x) for x in pairs.collect()} == want
    assert all(0 < x[3] <= 1 for x in want) and assoc.partners(pairs).count() == 2 * len(want)
    assert assoc.cooccur(spark.createDataFrame([], "t int, i string"), ["t"], "i").collect() == []


def test_rapid_edits_against_brute_force(spark):
    import datetime

    r = random.Random(2)
    rows = [(k, datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randint(0, 60))) for k in range(12) for _ in range(r.randint(0, 25))]
    want = {}
    for k in range(12):
        days = sorted(d for i, d in rows if i == k)
        for d in days:
            n = sum(d <= e <= d + datetime.timedelta(days=7) for e in days)
            if n >= 5:
                want[k] = (d, n)
                break
    got = {x.k: (x.start, x.n) for x in timewin.rapid_edits(spark.createDataFrame(rows, "k int, d date"), "k", "d").collect()}
    assert got == want


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "out")], "src string, dst string")
    score = {x: 0.25 for x in "abcd"}
    out = Counter(s for s, _ in [("a", 1)] * 3 + [("b", 1), ("c", 1), ("c", 1), ("d", 1)])
    links = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    for _ in range(20):
        score = {x: 0.15 / 4 + 0.85 * sum(score[s] / out[s] for s, d in links if d == x) for x in "abcd"}
    got = dict(graph.pagerank(nodes, edges).collect())
    assert got == pytest.approx(score) and sum(got.values()) < 1
    assert graph.pagerank(nodes.limit(0), edges).collect() == []


def test_pagerank_without_dangling_nodes_sums_to_one(spark):
    edges = spark.createDataFrame([(k, (k * 3 + j) % 10) for k in range(10) for j in (1, 2)], "src long, dst long")
    got = graph.pagerank(spark.range(10).withColumnRenamed("id", "node"), edges).agg(F.sum("score")).first()[0]
    assert got == pytest.approx(1)


def test_cycles_are_complete(spark):
    r = random.Random(3)
    e = {(r.randint(0, 7), r.randint(0, 7)) for _ in range(22)} | {(4, 4)}
    want = set()
    for k in range(1, 6):
        for p in itertools.permutations(range(8), k):
            if p[0] == min(p) and all((p[j], p[(j + 1) % k]) in e for j in range(k)):
                want.add((k, ">".join(map(str, p))))
    got = graph.cycles(spark.createDataFrame(list(e) * 2, "src int, dst int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_graph_shapes(spark):
    edges = spark.createDataFrame([("p/__init__.py", "p/a.py"), ("p/__init__.py", "q/b.py"), ("p/__init__.py", "p/hub.py"), ("x", "p/__init__.py"), ("x", "y"), ("y", "z")], "src string, dst string")
    hub = spark.createDataFrame([("p/__init__.py",), ("p/hub.py",)], "node string")
    got = graph.facades(edges, hub, F.col("src").endswith("__init__.py"), paths.dirname(F.col("node")))
    assert [tuple(r) for r in got.collect()] == [("p/__init__.py", ["p/a.py"])]
    nodes = spark.createDataFrame([("x",), ("lost",), ("lost.config",)], "node string")
    assert [r[0] for r in graph.orphans(nodes, edges, F.col("node").endswith(".config")).collect()] == ["lost"]
    assert ("x", "z", 1) in {tuple(r) for r in graph.two_hops(edges).collect()}
    many = spark.createDataFrame([(f"s{k}", f"t{k % 3}") for k in range(60)] + [("a", "u.py")] * 3, "src string, dst string")
    assert [r.node for r in graph.hubs(many).orderBy("rank").collect()] == ["t0", "t1", "t2", "u.py"]


def test_votes_and_evidence(spark):
    docs = spark.createDataFrame([("use zod",), ("use zod and yup",), ("yup",), ("zod",), (None,)], "t string")
    counts = vote.tally(docs, "t", [("schema", "zod", r"\bzod\b"), ("schema", "yup", r"\byup\b"), ("i18n", "t", r"(?<!\w)_\(['\"]")])
    assert [tuple(r) for r in vote.dominant(counts, {"schema": 3, "i18n": 1}).collect()] == [("schema", "zod", 3)]
    df = spark.createDataFrame([(7, 0, False), (3, 1, False), (1, 2, True), (0, 0, True)], "n int, o int, a boolean")
    got = [(r.points, r.confidence) for r in vote.evidence(df, F.col("n"), F.col("o"), F.col("a")).collect()]
    assert got == [(3, "high"), (2, "medium"), (3, "high"), (1, "low")]
    assert [r[0] for r in vote.stride(spark.range(10), "id", 3).collect()] == [0, 3, 6]


def test_completeness_warns_once_by_the_first_signal(spark):
    modified = spark.createDataFrame([("a", 0), ("b", 1)], "item string, idx int")
    partners = spark.createDataFrame([("b", "c", 0.9), ("a", "c", 0.31), ("a", "b", 0.9), ("b", "d", 0.25)], "item string, partner string, strength double")
    edges = spark.createDataFrame([(f"s{k}", "a") for k in range(5)] + [("c", "b"), ("d", "a")], "src string, dst string")
    tests = spark.createDataFrame([("a", "a.test", 1), ("b", "s1", 1)], "item string, test string, pos int")
    got = {r.target: (r.signal, r.confidence, r.cause) for r in changes.completeness(modified, partners, edges, tests).collect()}
    assert got == {"c": ("co-change", "medium", "a"), "d": ("import", "medium", "a"), "a.test": ("test", "medium", "a")} | {f"s{k}": ("import", "medium", "a") for k in range(5)}


def test_companions_open_gates_once(spark):
    rows = [("x", "p", 1, "co-change", 0.4, False), ("x", "p", 3, "prefix", 0.4, True), ("x", "q", 3, "prefix", 0.4, True), ("x", "q", 4, "folder", 0.35, True), ("x", "r", 1, "co-change", 0.2, False), ("x", "s", 1, "co-change", 0.6, False), ("x", "s", 2, "import", 0.6, False)]
    got = {r.companion: (r.score, r.signals, r["rank"]) for r in changes.companions(spark.createDataFrame(rows, "item string, companion string, stage int, signal string, points double, gated boolean")).collect()}
    assert got == {"s": (1.0, "co-change,import", 1), "p": (0.4, "co-change", 2), "q": (0.4, "prefix", 3)}


def test_accuracy(spark):
    g = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "x")], "k int, i string")
    w = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d"), (2, "c"), (4, "y")], "k int, i string")
    got = {r.k: tuple(r)[1:] for r in changes.accuracy(g, w, "k", "i").collect()}
    assert got == {1: (1, 0.3333, 0.5, 0.4), 2: (1, 1.0, 1.0, 1.0), 3: (0, 0.0, 0.0, 0.0), 4: (0, 0.0, 0.0, 0.0)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9).map(lambda x: x * 11), st.integers(0, 50)), min_size=1, max_size=12), st.integers(0, 200))
def test_budget_against_a_plain_loop(spark, rows, limit):
    kept, total = dict(enumerate(rows)), sum(t for _, t in rows)
    for k, (p, t) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if total > limit and p < 90:
            del kept[k]
        if p < 90 or total <= limit:
            total -= t if k not in kept else 0
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "pos int, priority int, tokens int")
    for drop in (report.budget, report.budget_by_priority):
        assert sorted(r.pos for r in drop(df, limit).collect()) == sorted(kept)


def test_sections_merge_and_lines(spark):
    md = spark.createDataFrame([(1, "intro\n## One\nbody\n## Two\n")], "k int, t string")
    got = report.sections(md, "k", "t")
    assert [(r.header, r.body) for r in got.orderBy("pos").collect()] == [("", "intro\n"), ("One", "body\n"), ("Two", "")]
    new = spark.createDataFrame([(0, "One", "fresh")], "pos int, header string, body string")
    assert [(r.header, r.body) for r in report.merge(new, got, ["Known"]).orderBy("ord").collect()] == [("One", "fresh"), ("Two", "")]
    a, b = spark.createDataFrame([("x\n y \ny\n\nz",)], "t string"), spark.createDataFrame([("z\nq",)], "t string")
    assert {tuple(r) for r in report.new_lines(a, b, "t").collect()} == {("x", 1), ("y", 2)}


def test_statistics(spark):
    rows = spark.createDataFrame([("a", "t1", 1.0), ("a", "t1", 3.0), ("b", "t1", 1.0), ("a", "t2", 5.0), ("b", "t2", 5.005)], "side string, task string, v double")
    got = {(r.side, r.task): (r.n, r["mean"], r.sd) for r in report.run_stats(rows, ["side", "task"], "v").collect()}
    assert got["a", "t1"] == (2, 2.0, 1.4142) and got["b", "t1"] == (1, 1.0, 0.0)
    means = rows.groupBy("side", "task").agg(F.avg("v").alias("m"))
    assert tuple(report.wins(means, "task", "side", "m", "a", "b").first()) == (1, 1, 0)
    assert [tuple(r) for r in report.divergence(means, "task", "m").collect()] == [("t1", 1.0)]
    assert report.ci95(report.run_stats(rows, ["side", "task"], "v")).where("n = 2").first().half_width == pytest.approx(12.706, abs=1e-3)


def test_retrieval(spark):
    df = spark.createDataFrame([(1, "How do I Test auth?"), (2, "testing"), (3, None)], "k int, q string")
    assert [r.k for r in report.search(df, "AUTH", "q").collect()] == [1]
    assert {tuple(r)[2:] for r in report.topics(df, "q", {"tests": ["test"], "auth": ["auth", "login"]}).where("k = 1").collect()} == {("tests", 2), ("auth", 2)}
    assert [tuple(r)[2:] for r in report.topics(df, "q", {"tests": ["test"]}).where("k = 2").collect()] == [("tests", 1)]


def test_divergence_is_judged_before_it_is_rounded(spark):
    import duckdb

    pairs = [0.5, 0.50002, 0.50006, 0.49998, 0.8422499999999999, 0.43674999999999997 + 0.5, None]
    means = spark.createDataFrame([(k, v) for k, d in enumerate(pairs) for v in (0.0, d)], "k int, m double")
    got = {tuple(r) for r in report.divergence(means, "k", "m", 0.5).collect()}
    values = ", ".join(f"({k}, {v}::DOUBLE)" for k, d in enumerate(pairs) if d for v in (0.0, d))
    assert got == set(duckdb.sql(f"SELECT k, round(max(m) - min(m), 4) FROM (VALUES {values}) t(k, m) GROUP BY 1 HAVING max(m) - min(m) > 0.5").fetchall())
    assert (1, 0.5) in got and (4, 0.8423) in got and len(got) == 4
