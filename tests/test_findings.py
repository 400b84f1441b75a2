"""Findings of a scan: file sets, samples, dominant patterns, conventions, validation."""

import pytest

from tesserae.operators import findings, patterns, rules


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def names(df):
    return {r.name: r for r in df.collect()}


FASTAPI = "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/items')\ndef f(): pass"


@pytest.mark.parametrize("folder, mode, found", [("docs_src/tutorial", "library", False), ("docs", "app", False), ("examples", "app", False), ("example-apps/a", "app", False), ("tests", "app", False), ("app", "app", True)])
def test_who_votes(spark, folder, mode, found):
    files = tree(spark, {f"{folder}/api{k}.py": FASTAPI for k in range(5)})
    assert ("FastAPI endpoints" in {r.name for r in patterns.dominant(files, mode).collect()}) == found


def test_test_files_vote_on_tests_only(spark):
    files = {f"src/a{k}.test.ts": "describe('x', () => { useQuery(k) })" for k in range(4)} | {"package.json": '{"devDependencies": {"vitest": "1"}}'}
    assert {tuple(r) for r in patterns.dominant(tree(spark, files)).collect()} == {("test", "Vitest", 4)}
    notes = {f"a{k}.md": "useQuery(k) prisma.user" for k in range(9)} | {f"types/a{k}.d.ts": "useQuery(k)" for k in range(9)}
    assert patterns.dominant(tree(spark, notes)).collect() == []


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def ranks(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, rank int")


def sampled(spark, files, most, hints=(), churn=()):
    return [r.path for r in rules.sample(paths(spark, *files), most, ranks(spark, *hints), ranks(spark, *churn)).collect()]


def test_samples(spark):
    many = [f"src/file{k}.ts" for k in range(100)]
    assert sorted(sampled(spark, ["src/a.ts", "src/b.ts", "src/c.ts"], 50)) == ["src/a.ts", "src/b.ts", "src/c.ts"]
    assert {"src/index.ts", "src/config.ts", "src/app.ts"} <= set(sampled(spark, [*many, "src/index.ts", "src/config.ts", "src/app.ts"], 10))
    assert {"src/file50.ts", "src/file75.ts"} <= set(sampled(spark, many, 20, hints=[("src/file50.ts", 1), ("src/file75.ts", 2)]))
    assert "src/file99.ts" in sampled(spark, many, 20, churn=[("src/file99.ts", 1)])
    assert sorted(sampled(spark, ["src/index.ts", "src/a.ts", "src/b.ts"], 2, [("src/index.ts", 1)], [("src/index.ts", 1)])).count("src/index.ts") == 1
    assert len(sampled(spark, many + [f"lib/file{k}.ts" for k in range(100)], 50)) == 50
    left_out = ["src/types.d.ts", "docs/guide.ts", "docs_src/tutorial/api.py", "benchmarks/webapp/express.js", "examples/a.ts"]
    assert sampled(spark, [*left_out, "src/a.ts"], 50) == ["src/a.ts"]
    python = [f"pydantic/file{k}.py" for k in range(100)] + ["pydantic/__init__.py", "pydantic/main.py"]
    assert {"pydantic/__init__.py", "pydantic/main.py"} <= set(sampled(spark, python, 10))
    assert {"src/config.ts", "src/layout.tsx"} <= set(sampled(spark, [f"docs/a{k}.md" for k in range(80)] + ["src/config.ts", "src/layout.tsx", *many], 10))


def test_a_tier_takes_what_those_before_it_left(spark):
    many = [f"src/file{k:03}.ts" for k in range(300)]
    hints = [(f"src/file{k:03}.ts", k) for k in range(1, 20)]
    churn = [(f"src/file{k:03}.ts", k) for k in range(1, 30)]
    got = rules.sample(paths(spark, "src/index.ts", *many), 20, ranks(spark, *hints), ranks(spark, *churn)).collect()
    by = {t: sorted(r.path for r in got if r.tier == t) for t in (1, 2, 3, 4)}
    assert by[1] == ["src/index.ts"] and by[2] == [f"src/file{k:03}.ts" for k in range(1, 11)] and by[3] == [f"src/file{k:03}.ts" for k in range(11, 16)] and len(by[4]) == 4
    assert len(sampled(spark, [f"src/index.{k}.ts" for k in range(30)] + many, 20)) == 20


def test_evidence_is_bounded_in_every_partition(spark):
    rows = spark.range(0, 1000, 1, 8).selectExpr("id % 3 AS rule", "format_string('f%04d', 999 - id) AS path")
    got = {r.rule: (r.n, r.paths) for r in findings.least(rows, ["rule"], "path", 5).collect()}
    assert got == {k: (len(x), x[:5]) for k, x in ((k, sorted(f"f{999 - i:04}" for i in range(k, 1000, 3))) for k in range(3))}
    plan = findings.least(rows, ["rule"], "path", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[-1][:200] + plan.split("WindowGroupLimit")[1][:200]


def test_dominant_findings_have_evidence_and_places(spark):
    files = {f"src/routes/r{k:02}.ts": 'express.Router(); prisma.user; jwt.verify(t); t("a")' for k in range(25)}
    files |= {"src/auth/middleware.ts": "jwt.verify(t)", "prisma/schema.prisma": "", "locales/de.json": "{}", "locales/en.json": "{}", "src/routes/r.test.ts": "express.Router()"}
    got = names(findings.of_patterns(tree(spark, files)))
    assert got["router"].n == 25 and got["router"].paths == [f"src/routes/r{k:02}.ts" for k in range(20)] and got["router"].confidence == "high"
    assert got["auth"].n == 26 and got["auth"].description.endswith("see src/auth/middleware.ts") and got["database"].description.endswith("see prisma/schema.prisma")
    assert len(got["i18n"].paths) == 3 and got["i18n"].description.endswith("see locales/en.json")
    assert got["route folders"].description == "Routes are defined in src/routes"
    quiet = names(findings.of_patterns(tree(spark, {"src/routes/a.ts": ""})))
    assert "route folders" not in quiet and "router" not in quiet


def test_conventions(spark):
    files = {f"src/m{k}/index.ts": 'export * from "./a"\nexport const a = 1\n' for k in range(3)}
    files |= {f"src/e{k}.ts": "class MyError extends Error {}\n" + "export function f() {}\n" * 5 + 'import a from "@/x"\n' * 6 for k in range(2)}
    files |= {f"svc/g{k}.go": 'if err != nil { return fmt.Errorf("x: %w", err) }\nfmt.Errorf("%w", e)\ntype A interface {\n}\ntype B interface {}' for k in range(3)}
    files |= {f"lib/p{k}/__init__.py": "from .a import something" for k in range(3)}
    got = set(names(findings.of_patterns(tree(spark, files))))
    assert {"barrel files", "error classes", "named exports", "imports by alias", "wrapped errors", "interfaces first", "package barrels"} <= got
    assert "named exports" not in names(findings.of_patterns(tree(spark, files), "library"))
    local = {f"src/m{k}/index.ts": "export { a };\nconst b = 2" for k in range(3)}
    assert "barrel files" not in names(findings.of_patterns(tree(spark, local)))
    assert "barrel files" not in names(findings.of_patterns(tree(spark, dict(list(files.items())[:2]))))


def test_environment_generated_and_folders(spark):
    files = {".env.example": "", "src/a.ts": "process.env.NEXT_PUBLIC_A + process.env.SECRET", "src/gen/a.generated.ts": "", "src/b.ts": "// @generated", "src/components/ui/x.tsx": "", "web/ui/y.vue": ""}
    files |= {f"packages/app-store/{n}/index.ts": "" for n in ("zoom", "meet", "_base", "teams")} | {f"src/plugins/{n}/index.ts": "" for n in ("a", "b")}
    got = names(findings.of_patterns(tree(spark, files)))
    assert {"example", "variables", "generated", "component folders", "integrations"} <= set(got)
    assert got["generated"].n == 2 and got["generated"].paths == ["src/b.ts", "src/gen/a.generated.ts"]
    assert got["component folders"].description == "Components are in src/components/ui, web/ui" and got["integrations"].description.endswith("packages/app-store")


def validated(spark, description, paths, ranked=True, areas=("src", "lib"), declared="high", category="Dominant patterns"):
    top = [("src/core.ts", 0.35), ("src/utils.ts", 0.25), ("src/types.ts", 0.2), ("src/api/handler.ts", 0.15), ("src/db/client.ts", 0.1)] if ranked else []
    rows = spark.createDataFrame([(category, "x", description, declared, len(paths), list(paths))], "category string, name string, description string, confidence string, n long, paths array<string>")
    return findings.validated(rows, spark.createDataFrame(top, "node string, score double"), spark.createDataFrame([(a,) for a in areas], "dir string")).first().confidence


@pytest.mark.parametrize("description, paths, ranked, areas, want", [
    ("none", [], True, ("src", "lib"), "high"),
    ("many and ranked", ["src/core.ts", "src/utils.ts", "src/types.ts", "src/a.ts", "src/b.ts", "src/c.ts"], True, ("src", "lib"), "high"),
    ("two files", ["other/x.ts", "other/y.ts"], True, (), "low"),
    ("three in an active area", ["src/a.ts", "src/b.ts", "src/c.ts"], True, ("src", "lib"), "medium"),
    ("twelve", [f"other/file{k}.ts" for k in range(12)], True, (), "high"),
    ("Auth uses NextAuth.js", ["src/auth/config.ts", "src/auth/middleware.ts", "src/auth/utils.ts"], True, ("src", "lib"), "medium"),
    ("Auth uses auth hooks", ["src/core.ts", "src/utils.ts", "src/auth/config.ts", "lib/middleware.ts", "pages/login.tsx"], True, ("src", "lib"), "high"),
    ("Database access uses Prisma", ["scripts/migrate.ts", "scripts/seed.ts"], True, (), "medium"),
    ("Database access uses Prisma", ["src/core.ts", "src/db/client.ts", "src/api/handler.ts"], True, ("src", "lib"), "high"),
    ("five", ["src/a.ts", "src/b.ts", "src/c.ts", "src/d.ts", "src/e.ts"], False, (), "medium"),
    ("strong", ["src/core.ts", "src/utils.ts", "src/types.ts", "src/a.ts", "src/b.ts"], True, ("src", "lib"), "high"),
    ("weak", ["other/x.ts"], True, ("src", "lib"), "low"),
    ("Auth in one folder, seven files", [f"src/auth/{k}.ts" for k in range(7)], True, ("src",), "medium"),
])
def test_validation(spark, description, paths, ranked, areas, want):
    assert validated(spark, description, paths, ranked, areas) == want
