"""Rule tables and context signals on small trees."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import changes, context, rules, tools


@pytest.fixture(scope="module")
def tree(spark):
    rows = {
        "package.json": '{"workspaces": null, "scripts": {"dev": "x", "test": "y", "db:migrate": "z", "foo": "q"}, "main": "i.js", "exports": "./i.js"}',
        "src/index.ts": 'export * from "./a";\nimport x from "@/b"',
        "src/auth/login.ts": "export default 1\nexport const a = 2\nclass E extends AppError {}",
        "src/auth/login.test.ts": "", "src/auth/loginForm.ts": "", "src/auth/token_store.ts": "// @generated by x",
        "src/providers/a/i.ts": "", "src/providers/b/i.ts": "", "src/providers/c.ts": "", "tests/test_x.py": "", "api/x.pb.go": "", "src/codegen/x.ts": "", "src/features/f.ts": "",
    }
    return spark.createDataFrame(list(rows.items()), "path string, content string")


def test_structure_and_mode(spark, tree):
    assert tuple(rules.structure(tree).first()) == (False, None, "mixed")
    assert rules.repo_mode(tree).first()[0] == "library" and rules.repo_mode(tree.limit(0)).first()[0] == "app"
    assert {(r.dir, r.n, r.purpose) for r in rules.folders(tree).collect()} == {("src", 10, "Source code"), ("tests", 1, "Tests"), ("api", 1, "API routes or endpoints")}
    manifests = tree.where("path = 'package.json'").select(F.lit(0).alias("pos"), "content")
    assert {tuple(r) for r in rules.build_commands(manifests).collect()} == {("dev", "x"), ("test", "y"), ("db:migrate", "z")}


@pytest.mark.parametrize("files, frameworks, want", [
    ({"src/index.ts": ""}, [], "app"), ({"pnpm-workspace.yaml": "", "packages/a/index.ts": ""}, [], "monorepo"), ({"turbo.json": ""}, [], "monorepo"), ({"lerna.json": ""}, [], "monorepo"), ({"nx.json": ""}, [], "monorepo"),
    ({"src/index.ts": "", "app/page.tsx": ""}, ["Next.js"], "app"), ({"pyproject.toml": "", "pydantic/__init__.py": "", "tests/test_main.py": ""}, [], "library"), ({"pyproject.toml": "", "tests/__init__.py": ""}, [], "app"),
    ({"pyproject.toml": "", "src/mylib/__init__.py": "", "src/mylib/core.py": ""}, [], "library"), ({"package.json": '{"type": "module"}'}, [], "library"), ({"package.json": '{"main": "i.js"}'}, [], "app"),
    ({"package.json": '{"exports": {".": "./i.js"}}'}, ["Next.js"], "app"), ({"package.json": '{"exports": "./i.js"}'}, ["React"], "library"), ({"package.json": '{"files": []}'}, [], "app"), ({"package.json": '{"files": ["dist"]}'}, [], "library"),
    ({"package.json": '{"workspaces": ["a/*"]}'}, [], "monorepo"), ({"package.json": "{"}, [], "app"), ({"package.json": '{"type": "module"}', "src/components/a.tsx": ""}, [], "app"), ({"setup.py": ""}, [], "library"), ({"setup.py": "", "app/a.py": ""}, [], "app"),
    ({"src/lib/a.ts": ""}, [], "library"), ({"lib/a.ts": "", "x/components/a.ts": ""}, [], "app"), ({"pyproject.toml": "", "scripts/__init__.py": ""}, [], "app"),
])
def test_modes(spark, files, frameworks, want):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    known = spark.createDataFrame([(f,) for f in frameworks], "framework string")
    assert rules.repo_mode(rows, known).first()[0] == want


def test_detections(spark, tree):
    deps = spark.createDataFrame([("react", "18"), ("next", "14"), ("other", "1")], "name string, version string")
    assert [tuple(r) for r in rules.frameworks(deps).collect()] == [("Next.js", "14")]
    assert {r.framework for r in rules.frameworks(deps.where("name <> 'next'")).collect()} == {"React"}
    vite = spark.createDataFrame([("vite", "5")], "name string, version string")
    assert [tuple(r) for r in rules.frameworks(deps.where("name = 'react'").union(vite)).collect()] == [("Vite + React", "5")] and rules.frameworks(vite).collect() == []
    assert {r.path for r in rules.generated(tree).collect()} == {"src/auth/token_store.ts", "src/codegen/x.ts"}
    shops = spark.createDataFrame([(f"src/{x}/i.ts",) for x in ("plugins/a", "plugins/b", "plugins/_c", "addons/a", "addons/b", "addons/c", "providers/a", "providers/b", "providers/c", "providers/d")], "path string")
    assert [tuple(r) for r in rules.integrations(shops).collect()] == [("src/addons", 3)] and rules.integrations(tree).collect() == []
    got = {r.name: r.n for r in rules.conventions(tree).collect()}
    assert got["barrels"] == 1 and got["alias imports"] == 1 and got["default exports"] == 1 and got["named exports"] == 1 and got["error classes"] == 0
    assert tree.where(rules.is_graph_source(F.col("path"))).count() == 12


def test_tiers_and_overrides(spark):
    f = spark.createDataFrame([("Core modules", "x", "high"), ("Style", "never do", "high"), ("Style", "plain", "high"), ("Style", "y", "medium"), ("Style", "z", "low")], "category string, description string, confidence string")
    assert sorted((r.tier) for r in rules.tiers(f).collect()) == ["critical", "critical", "important", "supplementary"]
    rows = [("plain", "low", 12, 3, 0, "high"), ("plain", "low", 3, 1, 0, "low"), ("Auth uses x", "high", 7, 1, 0, "high"), ("Auth uses x", "high", 7, 2, 0, "high"), ("a Database", "low", 2, 2, 0, "high"), ("plain", "low", 1, 1, 0, "high")]
    g = spark.createDataFrame(rows, "description string, confidence string, n int, dirs int, overlap int, declared string")
    assert [r.confidence for r in rules.revised(g).collect()] == ["high", "medium", "medium", "high", "medium", "low"]
    k = spark.createDataFrame([("core_modules",), ("none",)], "k string")
    assert [tuple(r) for r in k.select(rules.section_priority(F.col("k"), F.lit("library")), rules.section_priority(F.col("k"), F.lit("app"))).collect()] == [(90, 50), (0, 0)]


def test_signals_rank_companions(spark, tree):
    edges = spark.createDataFrame([("src/auth/login.ts", "src/auth/token_store.ts"), ("src/index.ts", "src/auth/login.ts"), ("src/auth/login.test.ts", "src/auth/login.ts")], "src string, dst string")
    partners = spark.createDataFrame([("src/auth/login.ts", "src/index.ts", 0.5)], "item string, partner string, strength double")
    signals = context.file_signals(spark.createDataFrame([("src/auth/login.ts",)], "item string"), partners, edges, tree)
    got = {r.companion: (r.score, r.signals) for r in changes.companions(signals).collect()}
    assert got == {"src/auth/token_store.ts": (0.65, "linked sibling,imports"), "src/index.ts": (0.6, "co-change,imported by"), "src/auth/loginForm.ts": (0.4, "name prefix")}


def test_tasks_find_files(spark, tree):
    tasks = spark.createDataFrame([(1, "Fix the login form and see token_store please"), (2, "change src/index.ts")], "task int, text string")
    assert {tuple(r) for r in context.keyword_files(tasks, tree, ("the",)).collect()} == {(1, "src/auth/loginForm.ts", "login_form"), (1, "src/auth/token_store.ts", "token_store")}
    assert {tuple(r) for r in context.mentioned(tasks, tree).collect()} == {(1, "src/auth/login.ts"), (1, "src/auth/token_store.ts"), (2, "src/index.ts")}
    tree2 = tree.select("path").union(spark.createDataFrame([("tests/x_test.ts",)], "path string"))
    got = context.test_candidates(spark.createDataFrame([("src/auth/login.ts",), ("tests/x.ts",), ("lone.go",)], "item string"), tree2)
    assert sorted(tuple(r) for r in got.collect()) == [("src/auth/login.ts", "src/auth/login.test.ts", 0), ("tests/x.ts", "tests/x_test.ts", 3)]
    said = F.split(F.lit("rework login form"), " ")
    assert {r.path for r in tree.where(tools.name_relevant(said, F.col("path"))).collect()} == {"src/auth/login.ts", "src/auth/loginForm.ts"}


def test_file_context(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.3)], "node string, score double")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a"), ("b", "c")], "src string, dst string")
    assert tuple(context.file_context("c", ranks, ranks.limit(0), edges).first()) == (3, 3, False, ["a", "b"], ["a"])


def test_exploded_tasks_are_not_broadcast(spark, tree):
    """Few rows as Spark sees them before they are exploded, which went past the driver's memory once broadcast."""
    tasks = spark.createDataFrame([(1, "fix the login form"), (2, "change src/index.ts"), (3, "fix the login form"), (4, None)], "task int, text string")
    for found in (context.keyword_files(tasks, tree), context.mentioned(tasks, tree)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    files = tree.withColumn("content", F.lit(""))
    edges = spark.createDataFrame([("src/index.ts", "src/auth/login.ts"), ("src/auth/login.ts", "src/auth/token_store.ts")], "src string, dst string")
    partners = spark.createDataFrame([("src/index.ts", "src/auth/login.ts", 0.5)], "item string, partner string, strength double")
    found = tools.analyse(tasks.union(tasks), files, edges, partners)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.task, []).append(tuple(r)[1:])
    alone = tools.analyse(tasks.where("task = 3"), files, edges, partners).collect()
    assert sorted(got[1]) == sorted(got[3]) == sorted(tuple(r)[1:] for r in alone) and 4 not in got and got[2]
