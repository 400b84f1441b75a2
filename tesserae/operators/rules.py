"""Rule tables over files and findings: frameworks, structure, modes, conventions and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import basename, is_program, is_sampled, top_dir
from ..functions.text import strip_comments
from . import windows
from .vote import stride

# What a dependency tells.
FRAMEWORKS = {
    "next": "Next.js", "expo": "Expo", "react": "React", "vite": "Vite", "@supabase/supabase-js": "Supabase", "tailwindcss": "Tailwind CSS",
    "express": "Express", "fastify": "Fastify", "typescript": "TypeScript",
}
HEADER = r"@generated|(?i:do not edit|auto-generated|this file is generated|generated by)"


def is_graph_source(path: Column) -> Column:
    """The files whose imports make up the dependency graph."""
    script = path.rlike(r"\.(tsx?|jsx?)$") & ~path.endswith(".d.ts") & ~path.rlike(r"(^|/)(docs[^/]*|examples[^/]*|benchmarks)/")
    python = path.endswith(".py") & ~path.rlike(r"(^|/)(docs[^/]*|examples[^/]*|benchmarks)/")
    go = path.endswith(".go") & ~path.endswith("_test.go") & ~path.rlike(r"(^|/)(vendor|testdata)/")
    rust = path.endswith(".rs") & ~path.rlike(r"(^|/)(target|tests)/")
    return script | python | go | rust


def frameworks(dependencies: DataFrame, spark_names: dict[str, str] | None = None) -> DataFrame:
    """(framework, version) of dependencies (name, version). React is named by itself only without what brings it along, and together
    with Vite where that builds it; Vite alone is no framework."""
    table = spark_names or FRAMEWORKS
    known = F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), F.col("name"))
    rows = dependencies.select(known.alias("framework"), "version").where("framework IS NOT NULL")
    facts = rows.agg(F.coalesce(F.bool_or(F.col("framework").isin("Next.js", "Expo")), F.lit(False)).alias("brought"), F.max(F.when(F.col("framework") == "Vite", F.col("version"))).alias("vite"))
    react = F.col("framework") == "React"
    rows = rows.crossJoin(F.broadcast(facts)).where(~(F.col("brought") & react) & (F.col("framework") != "Vite"))  # one row
    built = react & F.col("vite").isNotNull()
    return rows.select(F.when(built, "Vite + React").otherwise(F.col("framework")).alias("framework"), F.when(built, F.col("vite")).otherwise(F.col("version")).alias("version"))


def folders(files: DataFrame) -> DataFrame:
    """(dir, n, purpose) of the top-level folders of files (path); purpose is null where no rule names it."""
    purpose = F.element_at(F.create_map(*(F.lit(x) for p in fixed.PURPOSES.items() for x in p)), F.col("dir"))
    return files.where(F.contains(F.col("path"), F.lit("/"))).groupBy(top_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n")).withColumn("purpose", purpose)


def structure(files: DataFrame) -> DataFrame:
    """One row: monorepo, layout (feature, layer or null), and where tests are (colocated, separate, mixed or none)."""
    p, top = F.col("path"), F.when(F.contains(F.col("path"), F.lit("/")), top_dir(F.col("path")))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    row = files.agg(
        has(p.isin("pnpm-workspace.yaml", "lerna.json") | top.isin("packages", "apps")).alias("monorepo"),
        has(top.isin("features", "modules")).alias("feature"),
        has(top == "components").alias("components"),
        has(top.isin("services", "utils")).alias("beside"),
        has(p.contains(".test.") | p.contains(".spec.")).alias("near"),
        has(top.isin("test", "tests", "__tests__")).alias("apart"),
    )
    layout = F.when(F.col("feature"), "feature").when(F.col("components") & F.col("beside"), "layer")
    tests = F.when(F.col("near") & F.col("apart"), "mixed").when(F.col("near"), "colocated").when(F.col("apart"), "separate").otherwise("none")
    return row.select("monorepo", layout.alias("layout"), tests.alias("tests"))


def entry_points(files: DataFrame) -> DataFrame:
    """(path) of the files that programs start at."""
    return files.where(F.col("path").isin(*fixed.ENTRIES)).select("path")


def language_stack(files: DataFrame) -> DataFrame:
    """(framework) of Python and Go: by manifests at the root, Python only with five primary files of its own.

    FastAPI needs three files that import it; Flask and the rest need none. Go's are told by the module file.
    """
    p, c = F.col("path"), F.coalesce(F.col("content"), F.lit(""))
    at = lambda name: F.max(F.when(p == name, F.lower(c)))
    primary = p.endswith(".py") & ~p.rlike(r"(test[s_]?/|bench/|scripts?/|docs[_/]|examples?/|fixtures?/)") & ~p.startswith(".")
    row = files.agg(
        at("pyproject.toml").alias("project"), at("requirements.txt").alias("requirements"), F.coalesce(F.bool_or(p == "setup.py"), F.lit(False)).alias("setup"), at("go.mod").alias("go"),
        F.count_if(primary).alias("primary"), F.count_if(primary & c.rlike(r"from fastapi|import fastapi|FastAPI\(")).alias("fast"),
    )
    deps = F.coalesce("project", "requirements", F.lit(""))
    python = F.when(deps.contains("django"), "Django").when(deps.contains("fastapi"), F.when(F.col("fast") >= 3, "FastAPI").otherwise("Python")).when(deps.contains("flask"), "Flask").otherwise("Python")
    python = F.when((F.col("project").isNotNull() | F.col("requirements").isNotNull() | F.col("setup")) & (F.col("primary") >= 5), python)
    go = F.when(F.col("go").contains("github.com/gin-gonic/gin"), "Go + Gin").when(F.col("go").contains("github.com/labstack/echo"), "Go + Echo").when(F.col("go").contains("github.com/gofiber/fiber"), "Go + Fiber").when(F.col("go").isNotNull(), "Go")
    return row.select(F.explode(F.filter(F.array(python, go), lambda x: x.isNotNull())).alias("framework"))


def fallback_commands(files: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (name, command), and for names without one what other build files at the root offer; the first offer wins.

    A single program under cmd/ is what is run in development, whatever else is offered.
    """
    p = F.col("path")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    program = F.regexp_extract(p, r"^cmd/([^/]+)", 1)
    row = files.agg(
        has(p == "Makefile").alias("make"), has((p == "pyproject.toml") & F.contains(F.coalesce("content", F.lit("")), F.lit("[tool.poetry.scripts]"))).alias("poetry"), has(p == "go.mod").alias("go"),
        has(p == "requirements.txt").alias("requirements"), F.countDistinct(F.when(program != "", program)).alias("programs"), F.min(F.when(program != "", program)).alias("program"),
    )
    offers = [
        (F.col("go") & (F.col("programs") == 1), -1, "dev", F.concat(F.lit("go run ./cmd/"), "program")),
        (F.col("make"), 1, "build", F.lit("make")), (F.col("poetry"), 2, "dev", F.lit("poetry run dev")), (F.col("poetry"), 2, "test", F.lit("poetry run pytest")),
        (F.col("go"), 3, "build", F.lit("go build ./...")), (F.col("go"), 3, "test", F.lit("go test ./...")), (F.col("go") & (F.col("programs") == 0), 3, "dev", F.lit("go run .")),
        (F.col("requirements"), 4, "test", F.lit("pytest")),
    ]
    table = F.filter(F.array(*(F.when(c, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), command.alias("command"))) for c, rank, name, command in offers)), lambda x: x.isNotNull())
    rows = row.select(F.explode(table).alias("r")).select("r.*").unionByName(commands.where("command IS NOT NULL").select(F.lit(0).alias("rank"), "name", "command"))
    return rows.groupBy("name").agg(F.min_by("command", "rank").alias("command"))


def repo_mode(files: DataFrame, frameworks: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, mode): monorepo, library or app, by the first rule that holds for files (by, path, content).

    frameworks (by, framework) are those that were found; some make an app of what would be a library. The root manifest is
    read as a VARIANT, so that fields of unlike types, and malformed manifests, hinder nothing.
    """
    by = by or []
    p = F.col("path")
    m = F.max(F.when(p == "package.json", F.coalesce("content", F.lit("")))).alias("m")
    has = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    row = files.groupBy(*by).agg(
        m,
        has(p.isin("pnpm-workspace.yaml", "turbo.json", "lerna.json", "nx.json")).alias("mono"),
        has(p.rlike(r"^(src/)?(app|pages)/")).alias("app"),
        has(p.contains("/components/")).alias("components"),
        has(p == "pyproject.toml").alias("pyproject"),
        has(p.rlike(r"^src/.*\.py$")).alias("inside"),
        has(p.rlike(r"^(?!(?:test|tests|docs|examples|scripts|tools|benchmarks|\.github)/)[^/]+/__init__\.py$")).alias("package"),
        has(p.isin("setup.py", "setup.cfg")).alias("setup"),
        has(p.rlike(r"^(src/)?lib/")).alias("lib"),
    )
    if frameworks is not None:
        known = frameworks.groupBy(*by).agg(has(F.col("framework").isin(*fixed.APP_FRAMEWORKS)).alias("framed"))
        row = row.join(known, by, "left") if by else row.crossJoin(F.broadcast(known))  # one row each
        row = row.withColumn("framed", F.coalesce("framed", F.lit(False)))
    else:
        row = row.withColumn("framed", F.lit(False))
    row = row.withColumn("m", F.try_parse_json("m"))
    field = lambda path, kind="string": F.try_variant_get("m", f"$.{path}", kind)
    given = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("m", f"$.{path}", "variant")) != "VOID", F.lit(False))
    listed = F.coalesce(F.size(field("files", "array<variant>")) > 0, F.lit(False))
    work = given("workspaces") & ~F.coalesce(field("workspaces").isin("false", "0", ""), F.lit(False))
    bare = ~F.col("app") & ~F.col("framed")
    mode = (
        F.when(F.col("mono") | work, "monorepo")
        .when((listed | given("exports")) & bare, "library")
        .when((field("type") == "module") & bare & ~F.col("components"), "library")
        .when(F.col("pyproject") & (F.col("inside") | F.col("package")) & ~F.col("app"), "library")
        .when(F.col("setup") & ~F.col("app") & ~F.col("components"), "library")
        .when(F.col("lib") & bare & ~F.col("components"), "library")
        .otherwise("app")
    )
    return row.select(*by, mode.alias("mode"))


def build_commands(manifests: DataFrame) -> DataFrame:
    """(name, command): the named scripts of manifests (pos, content); the first manifest that has one wins."""
    scripts = manifests.select("pos", F.explode(F.from_json("content", "scripts map<string,string>")["scripts"]).alias("name", "command"))
    wanted = F.col("name").isin("dev", "build", "test", "lint", "start") | F.col("name").rlike("migrate|seed|deploy|typecheck|generate")
    return scripts.where(wanted).groupBy("name").agg(F.min_by("command", "pos").alias("command"))


def generated(files: DataFrame) -> DataFrame:
    """(path) of files that say so in their first 500 characters or by name."""
    p = F.col("path")
    by_name = p.contains(".generated.") | p.contains(".gen.") | (p.endswith(".d.ts") & p.contains("generated")) | p.contains("__generated__") | p.contains("codegen")
    return files.where((by_name & ~p.contains("node_modules")) | F.coalesce(F.substring("content", 1, 500).rlike(HEADER), F.lit(False))).select("path")


def conventions(files: DataFrame) -> DataFrame:
    """(name, n): how often the programs among files (path, content) show import, export, error and package conventions.

    Comments are left out. Index files are counted over all files; error classes, barrels and packages count files.
    """
    p, c = F.col("path"), F.col("content")
    rows = files.select("path", F.when(is_program(p) & is_sampled(p), strip_comments(F.coalesce(c, F.lit("")))).alias("content"))
    n = lambda regex, where=F.lit(True): F.coalesce(F.sum(F.when(where & c.isNotNull(), F.regexp_count(c, F.lit(regex)))), F.lit(0))
    go, py, index = p.endswith(".go"), p.endswith(".py"), basename(p).startswith("index.") & ~p.contains("node_modules")
    counts = {
        "alias imports": n(r"from\s+['\"][@~]/[^'\"]*['\"]"),
        "relative imports": n(r"from\s+['\"]\.[^'\"]*['\"]"),
        "default exports": n(r"export\s+default\s"),
        "named exports": n(r"export\s+(?:const|function|class|type|interface)\s"),
        "error classes": F.count_if(c.rlike(r"class\s+\w+Error\s+extends\s+(?:Error|BaseError)")),
        "go files": F.count_if(c.isNotNull() & go),
        "wrapped errors": n(r"fmt\.Errorf\(.*%w", go),
        "error checks": n(r"if\s+err\s*!=\s*nil", go),
        "interfaces": n(r"type\s+\w+\s+interface\s*\{", go),
        "python files": F.count_if(c.isNotNull() & py),
        "package barrels": F.count_if(p.endswith("__init__.py") & (F.length(F.trim(c)) > 10)),
        "index files": F.count_if(index),
        "barrels": F.count_if(index & c.rlike(r"export\s+\{.*\}\s+from|export\s+\*\s+from")),
    }
    row = rows.agg(*(v.alias(f"c{k}") for k, v in enumerate(counts.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(f"c{k}").cast("long").alias("n")) for k, x in enumerate(counts)))).alias("v")).select("v.*")


def integrations(files: DataFrame, names: tuple[str, ...] = fixed.INTEGRATIONS, least: int = 3) -> DataFrame:
    """(dir, n): of the folders of such names, below another one, that whose children have the most distinct names."""
    p, found = F.col("path"), None
    for k, name in enumerate(names):
        pattern = rf"^(.*?/{name})/([^/]+)/"
        part = F.struct(F.lit(k).alias("k"), F.regexp_extract(p, pattern, 1).alias("dir"), F.regexp_extract(p, pattern, 2).alias("child"))
        found = F.array(part) if found is None else F.concat(found, F.array(part))
    rows = files.where(~p.contains("node_modules")).select(F.explode(found).alias("v")).select("v.*").where((F.col("dir") != "") & ~F.col("child").startswith("_"))
    best = rows.groupBy("k").agg(F.countDistinct("child").alias("n"), F.min("dir").alias("dir")).where(F.col("n") >= least)
    return best.orderBy(F.desc("n"), "k").limit(1).select("dir", "n")


def edit_points(files: DataFrame, kind: str, most: int = 3) -> DataFrame:
    """(dir): the first folders, by name, that hold routes or components."""
    p = F.col("path")
    if kind == "route":
        wanted = p.rlike(r"routes|routers|api/") & ~p.rlike(r"node_modules|\.test\.|\.spec\.|tests?/|__test|fixture|mock") & p.rlike(r"\.(ts|js|py|go)$")
        found = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    else:
        wanted = p.rlike(r"/(components|ui)/") & ~p.rlike(r"node_modules|\.test\.") & p.rlike(r"\.(tsx|jsx|vue|svelte)$")
        found = F.regexp_extract(p, r"^(.*/(?:components|ui))/", 1)
    return files.where(wanted).select(found.alias("dir")).where("dir <> ''").distinct().orderBy("dir").limit(most)


def is_critical(category: Column, description: Column) -> Column:
    words = "|".join(w.replace(".", r"\.") for w in fixed.CRITICAL_WORDS)
    return category.isin(*fixed.CRITICAL_CATEGORIES) | F.lower(description).rlike(words)


def tiers(findings: DataFrame) -> DataFrame:
    """findings (category, description, confidence) with tier: critical, important or supplementary; low ones go."""
    tier = F.when(F.col("confidence") == "high", F.when(is_critical(F.col("category"), F.col("description")), "critical").otherwise("important")).when(F.col("confidence") == "medium", "supplementary")
    return findings.withColumn("tier", tier).where(F.col("tier").isNotNull() & ~F.lower("description").contains("shallow clone"))


def revised(findings: DataFrame) -> DataFrame:
    """findings (description, confidence, n, dirs, overlap, declared) after the overrides that follow scoring, in order.

    Overwhelming numbers keep a declared high; three files keep anything from being low; authentication in one folder, without a
    ranked file, is medium at most; a database in two files, without a ranked one, is medium whatever it was.
    """
    about = lambda word: F.col("description").contains(word) | F.col("description").contains(word.lower())
    c = F.when((F.col("declared") == "high") & (F.col("n") >= 10), "high").otherwise(F.col("confidence"))
    c = F.when((c == "low") & (F.col("n") >= 3), "medium").otherwise(c)
    c = F.when(about("Auth") & (F.col("dirs") <= 1) & (F.col("overlap") == 0) & (c == "high"), "medium").otherwise(c)
    c = F.when(about("Database") & (F.col("n") <= 2) & (F.col("overlap") == 0), "medium").otherwise(c)
    return findings.withColumn("confidence", c)


def section_priority(key: Column, mode: Column) -> Column:
    """Priorities of report sections, by mode; commands come before all that may be dropped."""
    out = F.when(key == "commands", 95).otherwise(0)
    for k, (library, other) in fixed.PRIORITIES.items():
        out = F.when(key == k, F.when(mode == "library", library).otherwise(other)).otherwise(out)
    return out


def has_commands(commands: Column) -> Column:
    """Whether a map of commands has any that is set."""
    return F.coalesce(F.exists(F.map_values(commands), lambda v: v.isNotNull()), F.lit(False))


def told(command: Column) -> Column:
    """Whether the files give a command away."""
    return command.isin(*fixed.STANDARD_COMMANDS)


def sample(files: DataFrame, most: int, hints: DataFrame, churn: DataFrame, imported: int = 10, changed: int = 5) -> DataFrame:
    """(path, tier) of so many files: entry points, ten that many import, five that change much, then an even stride.

    hints and churn (path, rank) are short lists. Files that samples aren't drawn from take no part; where all others fit, all are
    taken (tier 0). What a tier may take is what those before it have left: counts of the tiers are a handful of numbers,
    and no window is laid over all files.
    """
    p = F.col("path")
    rows = files.where(is_sampled(p)).select("path").distinct()
    if rows.limit(most + 1).count() <= most:
        return rows.select("path", F.lit(0).alias("tier"))
    entry = p.rlike(r"index\.|config\.|app\.|layout\.|middleware\.") | basename(p).isin("__init__.py", "main.py")
    others = lambda table, k: table.where(~entry).join(rows, "path", "left_semi").orderBy("rank", "path").limit(k)
    second = others(hints, imported).select("path", F.lit(2).alias("tier"))
    third = others(churn.join(second, "path", "left_anti"), changed).select("path", F.lit(3).alias("tier"))
    chosen = rows.where(entry).select("path", F.lit(1).alias("tier")).unionByName(second).unionByName(third).orderBy("tier", "path").limit(most)
    chosen = windows.cut(chosen)  # at most `most` rows
    left = most - chosen.count()
    if left <= 0:
        return chosen
    rest = rows.where(~entry).join(F.broadcast(chosen.where("tier > 1").select("path")), "path", "left_anti")
    return chosen.unionByName(stride(rest, "path", left).withColumn("tier", F.lit(4)))
