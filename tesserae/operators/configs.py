"""Findings from configuration files, over any number of projects at once.

files (by, path, content): manifests of unlike shapes are read as VARIANT values, so that a field of another type, or a
malformed manifest, tells nothing and hinders nothing. One aggregation a project folds paths and configurations into flags
(facts); frameworks and findings are rules over its row. Dependencies are folded over all manifests of a project first, the
last one by path winning, and only those that some rule asks for go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import repo_mode

# Dependencies that tell of frameworks; folders whose manifests don't count; configurations at the root.
KNOWN = ("next", "expo", "expo-router", "react", "vite", "@supabase/supabase-js", "tailwindcss", "express", "fastify", "typescript")
LEFT_OUT = r"(?i)(^|/)(examples?|demos?|benchmarks?|docs?([_-][^/]+)?|fixtures?)/"
NEXT_CONFIG, STYLE_CONFIG = r"^next\.config\.(js|mjs|ts)$", r"^tailwind\.config\.(js|ts|mjs|cjs)$"
ROOT_CONFIGS = ("next.config.js", "next.config.ts", "vite.config.ts", "tailwind.config.ts", "postcss.config.js", "vitest.config.ts")
NOT_PRIMARY = r"(test[s_]?/|bench/|scripts?/|docs[_/]|examples?/|fixtures?/)"
GO_FRAMEWORKS = {"github.com/gin-gonic/gin": "Go + Gin", "github.com/labstack/echo": "Go + Echo", "github.com/gofiber/fiber": "Go + Fiber"}
FINDING = "array<struct<framework:string,category:string,name:string,description:string,confidence:string>>"


def dependencies(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, version) over a project's package manifests; the last manifest by path wins, and in it those for development."""
    p = F.col("path")
    manifests = files.where(p.endswith("package.json") & ~p.contains("node_modules") & ~p.rlike(LEFT_OUT))
    v = F.try_parse_json("content")
    part = lambda k, field: F.struct(F.lit(k).alias("k"), F.try_variant_get("v", f"$.{field}", "map<string,variant>").alias("d"))
    rows = manifests.select(*by, "path", v.alias("v")).select(*by, "path", F.explode(F.array(part(0, "dependencies"), part(1, "devDependencies"))).alias("part"))
    rows = rows.select(*by, "path", "part.k", F.explode("part.d").alias("name", "version"))
    return rows.groupBy(*by, "name").agg(F.max_by(F.try_variant_get("version", "$", "string"), F.struct("path", "k")).alias("version"))


def facts(files: DataFrame, by: list[str]) -> DataFrame:
    """One row a project: what its paths and its configuration files show, and the versions of known dependencies (deps)."""
    p, c = F.col("path"), F.coalesce("content", F.lit(""))
    has = lambda x: F.coalesce(F.bool_or(F.coalesce(x, F.lit(False))), F.lit(False))
    held = lambda name: F.max(F.when(p == name, c))
    first = lambda pattern: F.min_by(F.when(p.rlike(pattern), c), F.when(p.rlike(pattern), p))
    top = lambda *names: p.rlike(f"^({'|'.join(names)})/")
    primary = p.endswith(".py") & ~p.rlike(NOT_PRIMARY) & ~p.startswith(".")
    columns = {
        "app": has(p.rlike(r"^(src/)?app/")), "pages": has(p.rlike(r"^(src/)?pages/")), "next_config": first(NEXT_CONFIG), "eas": has(p == "eas.json"), "app_json": F.try_parse_json(held("app.json")),
        "supabase": has(top("supabase")), "style_config": first(STYLE_CONFIG), "tsconfig": F.try_parse_json(held("tsconfig.json")),
        "features": has(top("features", "modules")), "components": has(top("components")), "beside": has(top("services", "utils")), "src": has(top("src")),
        "root_code": has(~p.contains("/") & p.rlike(r"\.(ts|js)$") & ~p.isin(*ROOT_CONFIGS)), "mono": has(p.isin("pnpm-workspace.yaml", "lerna.json") | top("packages", "apps")),
        "near": has(p.contains(".test.") | p.contains(".spec.")), "apart": has(top("test", "tests", "__tests__")),
        "pyproject": held("pyproject.toml"), "requirements": held("requirements.txt"), "setup": has(p == "setup.py"), "primary": F.count_if(primary),
        "fast": F.count_if(primary & c.rlike(r"(?m)^from fastapi import|^import fastapi")), "settings": F.min(F.when(p.endswith("settings.py") | p.contains("settings/"), p)),
        "models": has(p.endswith("models.py")), "venv": has(p.rlike(r"^\.?venv/")),
        "go_mod": held("go.mod"), "cmd": has(top("cmd")), "pkg": has(top("pkg")), "internal": has(top("internal")),
    }
    rows = files.where(p.isNotNull()).groupBy(*by).agg(*(v.alias(k) for k, v in columns.items()))
    known = dependencies(files.where(p.isNotNull()), by).where(F.col("name").isin(*KNOWN)).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", "version"))).alias("deps"))  # ten at most
    return rows.join(known, by, "left").withColumn("deps", F.coalesce("deps", F.create_map().cast("map<string,string>")))


def _deps(name: str) -> Column:
    """The version of a dependency; null where there is none (or an empty one)."""
    v = F.element_at("deps", F.lit(name))
    return F.when(v != "", v)


def _python() -> tuple[Column, Column]:
    """Which framework a Python project has, null if Python isn't primary, and its dependencies in lower case."""
    deps = F.lower(F.coalesce("pyproject", "requirements", F.lit("")))
    named = F.when(deps.contains("django"), "Django").when(deps.contains("fastapi"), F.when(F.col("fast") >= 3, "FastAPI").otherwise("Python")).when(deps.contains("flask"), "Flask").otherwise("Python")
    given = F.col("pyproject").isNotNull() | F.col("requirements").isNotNull() | F.col("setup")
    return F.when(given & (F.col("primary") >= 5), named), deps


def _go() -> Column:
    out = F.lit("Go")
    for module, name in reversed(GO_FRAMEWORKS.items()):
        out = F.when(F.col("go_mod").contains(module), name).otherwise(out)
    return F.when(F.col("go_mod").isNotNull(), out)


def frameworks(known: DataFrame, by: list[str]) -> DataFrame:
    """(by, framework, version) of the rows of facts(). React counts by itself only without those that bring it along."""
    alone = _deps("next").isNull() & _deps("expo").isNull()
    react = F.when(alone, _deps("react"))
    found = [
        (F.lit("Next.js"), _deps("next")), (F.lit("Expo"), _deps("expo")), (F.when(_deps("vite").isNotNull(), "Vite + React").otherwise("React"), F.when(react.isNotNull(), F.coalesce(_deps("vite"), react))),
        (F.lit("Supabase"), _deps("@supabase/supabase-js")), (F.lit("Tailwind CSS"), _deps("tailwindcss")), (F.lit("Express"), _deps("express")), (F.lit("Fastify"), _deps("fastify")), (F.lit("TypeScript"), _deps("typescript")),
        (_python()[0], F.when(_python()[0].isNotNull(), "")), (_go(), F.when(_go().isNotNull(), "")),
    ]
    each = F.filter(F.array(*(F.struct(name.alias("framework"), version.alias("version")) for name, version in found)), lambda x: x["version"].isNotNull())
    return known.select(*by, F.explode(each).alias("f")).select(*by, "f.framework", F.nullif("f.version", F.lit("")).alias("version"))


def findings(known: DataFrame, by: list[str]) -> DataFrame:
    """(by, framework, category, name, description, confidence): what configurations tell that code alone doesn't; framework is null for structure."""
    ts, next_, expo = _deps("typescript").isNotNull(), _deps("next").isNotNull(), _deps("expo").isNotNull()
    config = F.col("next_config")
    strict = F.try_variant_get("tsconfig", "$.compilerOptions.strict", "variant")
    off = (F.schema_of_variant(strict) == "BOOLEAN") & ~F.try_variant_get("tsconfig", "$.compilerOptions.strict", "boolean")
    aliases = F.array_sort(F.array_distinct(F.transform(F.map_keys(F.try_variant_get("tsconfig", "$.compilerOptions.paths", "map<string,variant>")), lambda k: F.regexp_replace(k, r"/\*", ""))))
    scheme = F.try_variant_get("app_json", "$.expo.scheme", "string")
    python, deps = _python()
    module = F.regexp_extract("go_mod", r"(?m)^module\s+(.+)$", 1)
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    go, label = F.col("go_mod").isNotNull(), _go()
    found = [
        (next_ & F.col("app") & F.col("pages"), F.lit("Next.js"), "Next.js routing", "both routers", F.lit("Both routers are in use: new routes go to app/"), "high"),
        (next_ & config.contains("output:") & config.contains("standalone"), F.lit("Next.js"), "Next.js deployment", "standalone", F.lit("The build is a standalone server"), "high"),
        (next_ & config.contains("images") & config.contains("remotePatterns"), F.lit("Next.js"), "Next.js images", "remote images", F.lit("Remote images need their domains configured"), "high"),
        (expo & F.col("eas"), F.lit("Expo"), "Expo builds", "eas", F.lit("Device builds run on EAS"), "high"),
        (expo & (scheme != ""), F.lit("Expo"), "Expo deep linking", "scheme", said("Deep links start with ", scheme, "://"), "high"),
        (_deps("@supabase/supabase-js").isNotNull() & F.col("supabase"), F.lit("Supabase"), "Supabase", "local setup", F.lit("Supabase is set up locally: migrations are pushed from there"), "high"),
        (_deps("tailwindcss").isNotNull() & F.col("style_config").contains("extend") & F.col("style_config").contains("colors"), F.lit("Tailwind CSS"), "Tailwind", "color tokens", F.lit("Colors are tokens of the configuration"), "medium"),
        (ts & off, F.lit("TypeScript"), "TypeScript", "strict", F.lit("Strict mode is off"), "high"),
        (ts & (F.size(aliases) >= 0), F.lit("TypeScript"), "TypeScript imports", "aliases", said("Path aliases: ", F.array_join(aliases, ", ")), "high"),
        (python == "Django", python, "Django", "management", said("Managed by manage.py", F.coalesce(said("; settings in ", F.col("settings")), F.lit(""))), "high"),
        ((python == "Django") & F.col("models"), python, "Django", "migrations", F.lit("Changed models need migrations"), "high"),
        (python == "FastAPI", python, "FastAPI", "schemas", F.lit("Requests and responses have Pydantic models"), "high"),
        ((python == "FastAPI") & deps.rlike("sqlalchemy|sqlmodel"), python, "FastAPI", "sessions", F.lit("Database sessions are injected and closed"), "high"),
        (python.isNotNull() & deps.contains("pytest"), python, "Testing", "pytest", F.lit("Tests run with pytest"), "high"),
        (python.isNotNull() & F.col("venv"), python, "Python environment", "venv", F.lit("A virtual environment is part of the tree"), "medium"),
        (go & (module != ""), label, "Go module", "module", said("Internal imports start with ", module), "high"),
        (go & F.col("cmd"), label, "Go layout", "layout", said("Programs are in cmd/", F.when(F.col("pkg"), " beside pkg/").otherwise(""), F.when(F.col("internal"), " beside internal/").otherwise("")), "high"),
        (go & F.col("internal"), label, "Go visibility", "internal", F.lit("Packages in internal/ stay inside the module"), "high"),
        (F.col("features"), F.lit(None), "Project structure", "by feature", F.lit("Code is grouped by feature"), "high"),
        (F.col("src") & F.col("root_code"), F.lit(None), "Project structure", "code at the root", F.lit("Some code lies beside src/: new code goes inside"), "medium"),
        (F.col("mono"), F.lit(None), "Project structure", "monorepo", F.lit("Several packages: shared code affects others"), "high"),
        (F.col("near") & ~F.col("apart"), F.lit(None), "Testing", "tests beside", F.lit("Tests lie beside what they test"), "high"),
        (F.col("apart") & ~F.col("near"), F.lit(None), "Testing", "tests apart", F.lit("Tests have a folder of their own"), "high"),
    ]
    rule = lambda f, category, name, description, sure: F.struct(f.cast("string").alias("framework"), F.lit(category).alias("category"), F.lit(name).alias("name"), description.alias("description"), F.lit(sure).alias("confidence"))
    each = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), rule(*rest)) for c, *rest in found)).cast(FINDING), lambda x: x.isNotNull())
    return known.select(*by, F.explode(each).alias("f")).select(*by, "f.*")


def modes(files: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """(by, mode) of each project, given its frameworks."""
    return repo_mode(files, found, by)
