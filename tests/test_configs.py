"""Findings from configuration files of several projects at once."""

import pytest

from tesserae.operators import configs


def told(spark, files, by=("project",)):
    rows = spark.createDataFrame([("p", k, v) for k, v in files.items()], "project string, path string, content string")
    known = configs.facts(rows, list(by))
    return {r.name: r for r in configs.findings(known, list(by)).collect()}, {r.framework: r.version for r in configs.frameworks(known, list(by)).collect()}


def package(*deps, dev=()):
    q = lambda xs: ", ".join(f'"{x}": "1"' for x in xs)
    return f'{{"dependencies": {{{q(deps)}}}, "devDependencies": {{{q(dev)}}}}}'


def test_next(spark):
    files = {"package.json": package("next", "react"), "app/a.tsx": "", "src/pages/b.tsx": "", "next.config.mjs": "output: 'standalone', images: { remotePatterns: [] }"}
    found, frameworks = told(spark, files)
    assert set(found) == {"both routers", "standalone", "remote images"} and frameworks == {"Next.js": "1"}
    assert set(told(spark, files | {"src/pages/b.tsx": None, "web/next.config.js": "", "package.json": package("next")} )[0]) >= {"standalone"}
    del files["src/pages/b.tsx"]
    assert "both routers" not in told(spark, files)[0]
    assert told(spark, files | {"package.json": package("react")})[0] == {}


@pytest.mark.parametrize("files, names, frameworks", [
    ({"package.json": package("expo", "react"), "eas.json": "{}", "app.json": '{"expo": {"scheme": "shop"}}'}, {"eas", "scheme"}, {"Expo": "1"}),
    ({"package.json": package("expo"), "app.json": '{"expo": {"scheme": ""}}'}, set(), {"Expo": "1"}),
    ({"package.json": package("expo"), "app.json": "{"}, set(), {"Expo": "1"}),
    ({"package.json": package("react", dev=["vite"])}, set(), {"Vite + React": "1"}),
    ({"package.json": package("vite")}, set(), {}),
    ({"package.json": package("@supabase/supabase-js", "tailwindcss"), "supabase/x.sql": "", "tailwind.config.js": "extend: { colors: {} }"}, {"local setup", "color tokens"}, {"Supabase": "1", "Tailwind CSS": "1"}),
    ({"package.json": package("tailwindcss"), "web/tailwind.config.js": "extend colors"}, set(), {"Tailwind CSS": "1"}),
    ({"package.json": package(dev=["typescript"]), "tsconfig.json": '{"compilerOptions": {"strict": false, "paths": {"@/*": ["src/*"]}}}'}, {"strict", "aliases"}, {"TypeScript": "1"}),
    ({"package.json": package(dev=["typescript"]), "tsconfig.json": '{"compilerOptions": {"strict": "false"}}'}, set(), {"TypeScript": "1"}),
    ({"package.json": package(dev=["typescript"]), "tsconfig.json": '// no JSON\n{"compilerOptions": {"strict": false}}'}, set(), {"TypeScript": "1"}),
    ({"package.json": package("left-pad"), "tsconfig.json": '{"compilerOptions": {"strict": false}}'}, set(), {}),
    ({"benchmarks/package.json": package("express"), "docs_src/package.json": package("react"), "packages/a/package.json": package("fastify")}, {"monorepo"}, {"Fastify": "1"}),
    ({"package.json": '{"dependencies": ["react"], "devDependencies": {"express": {"a": 1}}}'}, set(), {"Express": '{"a":1}'}),
    ({"go.mod": "module ex.org/m\nrequire github.com/gin-gonic/gin v1", "cmd/a/main.go": "", "internal/x.go": ""}, {"module", "layout", "internal"}, {"Go + Gin": None}),
    ({"pyproject.toml": "Django pytest", "site/settings.py": "", "site/models.py": "", ".venv/x": ""} | {f"m{k}.py": "" for k in range(5)}, {"management", "migrations", "pytest", "venv"}, {"Django": None}),
    ({"pyproject.toml": "fastapi sqlmodel"} | {f"m{k}.py": "from fastapi import x" for k in range(5)}, {"schemas", "sessions"}, {"FastAPI": None}),
    ({"pyproject.toml": "fastapi"} | {f"m{k}.py": "" for k in range(5)}, set(), {"Python": None}),
    ({"requirements.txt": "flask pytest"} | {f"m{k}.py": "" for k in range(5)}, {"pytest"}, {"Flask": None}),
    ({"pyproject.toml": "django"} | {f"bench/m{k}.py": "" for k in range(9)}, set(), {}),
    ({"features/a.ts": "", "src/a.ts": "", "index.ts": "", "a.test.ts": ""}, {"by feature", "code at the root", "tests beside"}, {}),
    ({"src/a.ts": "", "next.config.js": "", "tests/a.ts": ""}, {"tests apart"}, {}),
    ({"src/a.spec.ts": "", "tests/a.ts": ""}, set(), {}),
])
def test_rules(spark, files, names, frameworks):
    found, known = told(spark, files)
    assert set(found) == names and known == frameworks


def test_projects_do_not_mix(spark):
    rows = [("a", "package.json", package("next")), ("b", "package.json", package("react")), ("b", "app/x.tsx", ""), ("b", "pages/x.tsx", ""), (None, "package.json", package("expo")), ("c", None, "x"), ("d", "a.txt", None)]
    known = configs.facts(spark.createDataFrame(rows, "project string, path string, content string"), ["project"])
    assert {(r.project, r.framework) for r in configs.frameworks(known, ["project"]).collect()} == {("a", "Next.js"), ("b", "React")}
    assert configs.findings(known, ["project"]).collect() == []
    none = configs.facts(known.sparkSession.createDataFrame([], "project string, path string, content string"), ["project"])
    assert none.collect() == [] and configs.findings(none, ["project"]).collect() == []
