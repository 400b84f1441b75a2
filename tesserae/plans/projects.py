"""Queries over the configuration files of many projects: one for each customer, derived row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import configs, formats
from ..operators.windows import cut
from .catalog import query, table

K = "c_custkey"
DEPS = """CASE c_custkey % 7 WHEN 0 THEN '"next": "14.' || c_custkey % 5 || '"' WHEN 1 THEN '"expo": "50", "expo-router": "3"' WHEN 2 THEN '"react": "18.2", "vite": "5"' WHEN 3 THEN '"react": "18"'
 WHEN 4 THEN '"express": 4' WHEN 5 THEN '"@supabase/supabase-js": "2", "tailwindcss": "3"' ELSE '"fastify": "4"' END"""
EXTRA = """CASE c_nationkey % 6 WHEN 0 THEN ', "type": "module"' WHEN 1 THEN ', "workspaces": ["a"]' WHEN 2 THEN ', "exports": {".": "./i.js"}' WHEN 3 THEN ', "files": []' WHEN 4 THEN ', "files": ["dist"]' ELSE '' END"""
#: (path, content, which customers have the file); plain enough to mean the same in Spark and in DuckDB.
FILES = [
    ("'package.json'", f"""'{{"name": "p' || {K} || '", "dependencies": {{' || {DEPS} || '}}, "devDependencies": {{' || CASE WHEN {K} % 3 = 0 THEN '' ELSE '"typescript": "5"' END || '}}' || {EXTRA} || CASE WHEN {K} % 13 = 0 THEN '' ELSE '}}' END""", f"{K} % 11 <> 0"),
    ("'packages/x/package.json'", """'{"dependencies": {"react": "17", "left-pad": "1"}, "devDependencies": []}'""", f"{K} % 10 = 0"),
    ("'examples/x/package.json'", """'{"dependencies": {"fastify": "9", "next": "9"}}'""", f"{K} % 4 = 0"),
    ("'tsconfig.json'", """CASE c_custkey % 4 WHEN 0 THEN '{"compilerOptions": {"strict": false}}' WHEN 1 THEN '{"compilerOptions": {"strict": "false", "paths": {"~/*": ["x"], "@' || c_nationkey || '/*": ["src/*"]}}}' WHEN 2 THEN '// {"compilerOptions": {"strict": false}}' ELSE '{"compilerOptions": 1}' END""", f"{K} % 5 <> 0"),
    ("'next.config.mjs'", f"CASE {K} % 2 WHEN 0 THEN 'output: \"standalone\"' ELSE 'images: {{ remotePatterns: [] }}' END", f"{K} % 3 < 2"),
    ("'app.json'", f"""CASE {K} % 3 WHEN 0 THEN '{{"expo": {{"scheme": "s' || {K} || '"}}}}' WHEN 1 THEN '{{"expo": {{"scheme": ""}}}}' ELSE '{{"expo": []}}' END""", "true"),
    ("'eas.json'", "'{}'", f"{K} % 2 = 1"),
    ("'app/page.tsx'", "''", f"{K} % 4 < 2"),
    ("'pages/index.tsx'", "''", f"{K} % 4 IN (1, 2)"),
    ("'supabase/config.toml'", "''", f"{K} % 3 = 1"),
    ("'tailwind.config.ts'", f"CASE {K} % 2 WHEN 0 THEN 'extend: colors' ELSE '{{}}' END", "true"),
    ("'src/m.ts'", "''", f"{K} % 5 > 0"),
    ("'index.ts'", "''", f"{K} % 6 = 0"),
    ("'features/a.ts'", "''", f"{K} % 9 = 0"),
    ("'src/m.test.ts'", "''", f"{K} % 4 = 0"),
    ("'tests/a.py'", "''", f"{K} % 8 < 2"),
    ("'pyproject.toml'", f"CASE {K} % 4 WHEN 0 THEN 'dependencies = [\"FastAPI\", \"sqlmodel\", \"pytest\"]' WHEN 1 THEN '[project] Django' WHEN 2 THEN 'flask' ELSE '' END", "c_nationkey % 4 = 3"),
    ("'requirements.txt'", "'django'", "c_nationkey % 4 < 2"),
    *((f"'pkg{n}/models.py'", "'from fastapi import APIRouter'", f"{K} % 6 >= {n}") for n in range(5)),
    ("'site/settings.py'", "''", f"{K} % 2 = 0"),
    ("'.venv/x.py'", "''", f"{K} % 5 = 1"),
    ("'go.mod'", f"'module example.org/p' || {K} || CASE {K} % 3 WHEN 0 THEN chr(10) || 'require github.com/labstack/echo v4' ELSE '' END", f"{K} % 6 = 5"),
    ("'cmd/a/main.go'", "''", f"{K} % 12 = 5"),
    ("'internal/x.go'", "''", f"{K} % 12 > 6"),
]
FILES_SQL = " UNION ALL ".join(f"SELECT {K} AS project, {p} AS path, {c} AS content FROM customer WHERE {w}" for p, c, w in FILES)


def files(spark: SparkSession, d: str) -> DataFrame:
    """(project, path, content) of all projects, cut: they are read more than once."""
    each = F.array(*(F.expr(f"CASE WHEN {w} THEN named_struct('path', {p}, 'content', {c}) END") for p, c, w in FILES))
    rows = table(spark, d, "customer").select(F.col(K).alias("project"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
    return cut(rows.select("project", "f.*"))


J = "TRY_CAST(content AS JSON)"
BASE = rf"""f AS MATERIALIZED (SELECT project, path, content FROM ({FILES_SQL})),
m AS (SELECT project, path, {J} AS j FROM f WHERE path LIKE '%package.json' AND NOT regexp_matches(path, '(?i)(^|/)examples?/')),
r AS (SELECT project, path, 0 AS k, name, json_extract_string(j, '$.dependencies."' || name || '"') AS version FROM (SELECT *, unnest(json_keys(j, '$.dependencies')) AS name FROM m)
 UNION ALL SELECT project, path, 1, name, json_extract_string(j, '$.devDependencies."' || name || '"') FROM (SELECT *, unnest(json_keys(j, '$.devDependencies')) AS name FROM m)),
d AS MATERIALIZED (SELECT project, name, arg_max(version, path || k) AS version FROM r GROUP BY ALL),
v AS MATERIALIZED (SELECT project, max(CASE name WHEN 'next' THEN version END) AS next, max(CASE name WHEN 'expo' THEN version END) AS expo, max(CASE name WHEN 'react' THEN version END) AS react, max(CASE name WHEN 'vite' THEN version END) AS vite,
 max(CASE name WHEN 'typescript' THEN version END) AS ts, max(CASE name WHEN 'tailwindcss' THEN version END) AS tw, max(CASE name WHEN '@supabase/supabase-js' THEN version END) AS sb, max(CASE name WHEN 'express' THEN version END) AS express, max(CASE name WHEN 'fastify' THEN version END) AS fastify FROM d GROUP BY 1),
x AS MATERIALIZED (SELECT project, bool_or(path LIKE 'app/%') AS app, bool_or(path LIKE 'pages/%') AS pages, coalesce(max(CASE path WHEN 'next.config.mjs' THEN content END), '') AS nc, bool_or(path = 'eas.json') AS eas, max(CASE path WHEN 'app.json' THEN {J} END) AS aj,
 bool_or(path LIKE 'supabase/%') AS supabase, max(CASE path WHEN 'tailwind.config.ts' THEN content END) AS sc, max(CASE path WHEN 'tsconfig.json' THEN {J} END) AS tc, bool_or(path LIKE 'features/%') AS features, bool_or(path LIKE 'src/%') AS src, bool_or(path = 'index.ts') AS root_code,
 bool_or(path LIKE 'packages/%') AS mono, bool_or(path LIKE '%.test.%') AS near, bool_or(path LIKE 'tests/%') AS apart, max(CASE path WHEN 'pyproject.toml' THEN content END) AS pp, max(CASE path WHEN 'requirements.txt' THEN content END) AS rq,
 count(*) FILTER (path LIKE '%.py' AND path NOT LIKE 'tests/%' AND path NOT LIKE '.%') AS py, count(*) FILTER (path LIKE 'pkg%') AS fast, min(CASE WHEN path LIKE '%settings.py' THEN path END) AS settings, bool_or(path LIKE '%models.py') AS models, bool_or(path LIKE '.venv/%') AS venv,
 max(CASE path WHEN 'go.mod' THEN content END) AS gm, bool_or(path LIKE 'cmd/%') AS cmd, bool_or(path LIKE 'internal/%') AS internal FROM f GROUP BY 1),
y AS MATERIALIZED (SELECT *, lower(coalesce(pp, rq, '')) AS pd, CASE WHEN (pp IS NOT NULL OR rq IS NOT NULL) AND py >= 5 THEN CASE WHEN contains(pd, 'django') THEN 'Django' WHEN contains(pd, 'fastapi') THEN CASE WHEN fast >= 3 THEN 'FastAPI' ELSE 'Python' END WHEN contains(pd, 'flask') THEN 'Flask' ELSE 'Python' END END AS python,
 CASE WHEN contains(gm, 'labstack/echo') THEN 'Go + Echo' WHEN gm IS NOT NULL THEN 'Go' END AS go FROM x LEFT JOIN v USING (project)),
w AS MATERIALIZED (SELECT project, 'Next.js' AS framework, next AS version FROM y WHERE next IS NOT NULL UNION ALL SELECT project, 'Expo', expo FROM y WHERE expo IS NOT NULL
 UNION ALL SELECT project, CASE WHEN vite IS NULL THEN 'React' ELSE 'Vite + React' END, coalesce(vite, react) FROM y WHERE react IS NOT NULL AND next IS NULL AND expo IS NULL
 UNION ALL SELECT project, 'Supabase', sb FROM y WHERE sb IS NOT NULL UNION ALL SELECT project, 'Tailwind CSS', tw FROM y WHERE tw IS NOT NULL UNION ALL SELECT project, 'Express', express FROM y WHERE express IS NOT NULL
 UNION ALL SELECT project, 'Fastify', fastify FROM y WHERE fastify IS NOT NULL UNION ALL SELECT project, 'TypeScript', ts FROM y WHERE ts IS NOT NULL UNION ALL SELECT project, python, NULL FROM y WHERE python IS NOT NULL UNION ALL SELECT project, go, NULL FROM y WHERE go IS NOT NULL)"""


def _rules() -> str:
    said = [
        ("next IS NOT NULL AND app AND pages", "'Next.js'", "Next.js routing", "both routers", "'Both routers are in use: new routes go to app/'", "high"),
        ("next IS NOT NULL AND contains(nc, 'standalone')", "'Next.js'", "Next.js deployment", "standalone", "'The build is a standalone server'", "high"),
        ("next IS NOT NULL AND contains(nc, 'remotePatterns')", "'Next.js'", "Next.js images", "remote images", "'Remote images need their domains configured'", "high"),
        ("expo IS NOT NULL AND eas", "'Expo'", "Expo builds", "eas", "'Device builds run on EAS'", "high"),
        ("expo IS NOT NULL AND json_extract_string(aj, '$.expo.scheme') <> ''", "'Expo'", "Expo deep linking", "scheme", "'Deep links start with ' || json_extract_string(aj, '$.expo.scheme') || '://'", "high"),
        ("sb IS NOT NULL AND supabase", "'Supabase'", "Supabase", "local setup", "'Supabase is set up locally: migrations are pushed from there'", "high"),
        ("tw IS NOT NULL AND contains(sc, 'colors')", "'Tailwind CSS'", "Tailwind", "color tokens", "'Colors are tokens of the configuration'", "medium"),
        ("ts IS NOT NULL AND json_type(tc, '$.compilerOptions.strict') = 'BOOLEAN'", "'TypeScript'", "TypeScript", "strict", "'Strict mode is off'", "high"),
        ("ts IS NOT NULL AND json_type(tc, '$.compilerOptions.paths') = 'OBJECT'", "'TypeScript'", "TypeScript imports", "aliases", "'Path aliases: ' || array_to_string(list_sort([replace(a, '/*', '') FOR a IN json_keys(tc, '$.compilerOptions.paths')]), ', ')", "high"),
        ("python = 'Django'", "python", "Django", "management", "'Managed by manage.py' || coalesce('; settings in ' || settings, '')", "high"),
        ("python = 'Django' AND models", "python", "Django", "migrations", "'Changed models need migrations'", "high"),
        ("python = 'FastAPI'", "python", "FastAPI", "schemas", "'Requests and responses have Pydantic models'", "high"),
        ("python = 'FastAPI' AND contains(pd, 'sqlmodel')", "python", "FastAPI", "sessions", "'Database sessions are injected and closed'", "high"),
        ("python IS NOT NULL AND contains(pd, 'pytest')", "python", "Testing", "pytest", "'Tests run with pytest'", "high"),
        ("python IS NOT NULL AND venv", "python", "Python environment", "venv", "'A virtual environment is part of the tree'", "medium"),
        ("gm IS NOT NULL", "go", "Go module", "module", r"'Internal imports start with ' || regexp_extract(gm, 'module\s+(\S+)', 1)", "high"),
        ("gm IS NOT NULL AND cmd", "go", "Go layout", "layout", "'Programs are in cmd/' || CASE WHEN internal THEN ' beside internal/' ELSE '' END", "high"),
        ("gm IS NOT NULL AND internal", "go", "Go visibility", "internal", "'Packages in internal/ stay inside the module'", "high"),
        ("features", "NULL", "Project structure", "by feature", "'Code is grouped by feature'", "high"),
        ("src AND root_code", "NULL", "Project structure", "code at the root", "'Some code lies beside src/: new code goes inside'", "medium"),
        ("mono", "NULL", "Project structure", "monorepo", "'Several packages: shared code affects others'", "high"),
        ("near AND NOT apart", "NULL", "Testing", "tests beside", "'Tests lie beside what they test'", "high"),
        ("apart AND NOT near", "NULL", "Testing", "tests apart", "'Tests have a folder of their own'", "high"),
    ]
    return " UNION ALL ".join(f"SELECT project, {f} AS framework, '{c}' AS category, '{n}' AS name, {d} AS description, '{s}' AS confidence FROM y WHERE {w}" for w, f, c, n, d, s in said)


@query(f"WITH {BASE} SELECT project, framework, version FROM w")
def project_frameworks(spark, d):
    """The frameworks of each project, and the versions that its manifests ask for."""
    return configs.frameworks(configs.facts(files(spark, d), ["project"]), ["project"])


@query(f"WITH {BASE} {_rules()}")
def config_findings(spark, d):
    """What the configuration files of each project tell."""
    return configs.findings(configs.facts(files(spark, d), ["project"]), ["project"])


@query(f"""WITH {BASE}, a AS (SELECT project, bool_or(framework IN ('Next.js', 'FastAPI', 'Flask', 'Django')) AS framed FROM w GROUP BY 1),
p AS (SELECT project, {J} AS j FROM f WHERE path = 'package.json'), q AS (SELECT x.project, app OR pages AS app, coalesce(framed, false) AS framed, j, pp IS NOT NULL AS project_file FROM x LEFT JOIN a USING (project) LEFT JOIN p USING (project))
SELECT project, CASE WHEN json_type(j, '$.workspaces') = 'ARRAY' THEN 'monorepo' WHEN (coalesce(json_array_length(j, '$.files'), 0) > 0 OR json_type(j, '$.exports') = 'OBJECT') AND NOT app AND NOT framed THEN 'library'
 WHEN json_extract_string(j, '$.type') = 'module' AND NOT app AND NOT framed THEN 'library' ELSE 'app' END AS mode FROM q""")
def project_modes(spark, d):
    """Whether each project is a monorepo, a library or an application."""
    rows = files(spark, d)
    return configs.modes(rows, configs.frameworks(configs.facts(rows, ["project"]), ["project"]), ["project"])


@query(f"WITH {BASE} SELECT framework, count(*) AS projects FROM w GROUP BY 1")
def framework_counts(spark, d):
    """How many projects use each framework."""
    return project_frameworks(spark, d).groupBy("framework").agg(F.count(F.lit(1)).alias("projects"))


LIMIT = 110
_critical = "|".join(w.replace(".", r"\.") for w in fixed.CRITICAL_WORDS).replace("'", "''")
_layout = ", ".join(f"('{s.format}', {k}, '{s.key}', '{s.header}', {s.priority if s.priority is not None else fixed.PRIORITIES[s.key][1]}, '{s.style}')" for k, s in enumerate(x for x in formats.LAYOUT if x.told))


@query(f"""WITH {BASE}, told AS ({_rules()}),
i AS MATERIALIZED (SELECT project, CASE confidence WHEN 'high' THEN CASE WHEN category IN ({", ".join(f"'{c}'" for c in fixed.CRITICAL_CATEGORIES)}) OR regexp_matches(lower(description), '{_critical}') THEN 'critical' ELSE 'conventions' END ELSE 'supplementary' END AS key,
   category AS name, description AS text, category || chr(31) || description AS o FROM told
 UNION ALL SELECT {K}, 'commands', 'dev', 'run ' || {K}, '1dev' FROM customer WHERE {K} % 2 = 0 UNION ALL SELECT {K}, 'commands', 'seed', 's' || {K}, '9seed' FROM customer WHERE {K} % 3 = 0
 UNION ALL SELECT project, 'stack', NULL, framework, framework FROM w UNION ALL SELECT project, 'core_modules', NULL, path, '01' FROM f WHERE path = 'src/m.ts'),
l(format, pos, key, header, priority, style) AS (VALUES {_layout}),
s AS (SELECT DISTINCT project, key FROM i), c(key, text, o) AS (VALUES {", ".join(f"('{k}', '{v}', '{n}')" for n, (k, v) in enumerate(formats.CHECKS.items()))}),
a AS (SELECT project, key, name, text, o FROM i UNION ALL SELECT project, 'check', NULL, text, o FROM s JOIN c USING (key) WHERE project IN (SELECT project FROM s WHERE key IN ('core_modules', 'conventions'))),
n AS (SELECT project, format, pos, key, header, priority, style, name, o, CASE style WHEN 'bold command' THEN '- **' || CASE name WHEN 'dev' THEN 'Dev' ELSE name END || ':** `' || text || '`' WHEN 'command' THEN '- ' || CASE name WHEN 'dev' THEN 'Dev' ELSE name END || ': `' || text || '`'
  WHEN 'known command' THEN CASE name WHEN 'dev' THEN '- Dev: `' || text || '`' END WHEN 'bold' THEN '- **' || name || ':** ' || text WHEN 'plain' THEN '- ' || text WHEN 'code' THEN '- `' || text || '`' ELSE text END AS line FROM a JOIN l USING (key)),
g AS (SELECT project, format, pos, key, header, priority, style, name AS o, CASE WHEN count(*) = 1 THEN '- **' || name || ':** ' || any_value(line) ELSE '- **' || name || ':**' || chr(10) || string_agg('  - ' || line, chr(10) ORDER BY o) END AS line
  FROM (SELECT * EXCLUDE (o), o FROM n WHERE style = 'grouped') GROUP BY project, format, pos, key, header, priority, style, name),
b AS (SELECT project, format, pos, header, priority, CASE style WHEN 'list' THEN string_agg(line, ', ' ORDER BY o, line) ELSE string_agg(line, chr(10) ORDER BY o, line) END AS body FROM (SELECT project, format, pos, header, priority, style, o, line FROM n WHERE style <> 'grouped' AND line IS NOT NULL UNION ALL SELECT project, format, pos, header, priority, style, o, line FROM g) GROUP BY project, format, pos, header, priority, style
 UNION ALL SELECT project, format, pos, header, priority, CASE key WHEN 'header' THEN '{formats.SAYS["header"]}' ELSE '{formats.SAYS["footer"]}' END FROM (SELECT DISTINCT project FROM i), l WHERE style = 'fixed'),
t AS (SELECT *, CAST(ceil((length(header) + length(body) + 3) / 4.0) AS BIGINT) AS tokens FROM b),
k AS (SELECT * FROM t QUALIFY priority >= 90 OR sum(tokens) OVER (PARTITION BY project, format) - coalesce(sum(tokens) OVER (PARTITION BY project, format ORDER BY priority, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {LIMIT})
SELECT project, format, string_agg(header || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY pos) AS text FROM k GROUP BY ALL""")
def instruction_files(spark, d):
    """The instruction files of each project in four formats, within a budget that drops sections."""
    by = ["project"]
    known = cut(configs.facts(files(spark, d), by))
    customers = table(spark, d, "customer")
    command = lambda name, text, every: customers.where(F.col(K) % every == 0).select(F.col(K).alias("project"), F.lit(name).alias("name"), F.concat(F.lit(text), F.col(K).cast("string")).alias("command"))
    commands = command("dev", "run ", 2).unionByName(command("seed", "s", 3)).unionByName(customers.select(F.col(K).alias("project"), F.lit("test").alias("name"), F.lit("pytest").alias("command")))
    ranked = customers.where(F.col(K) % 5 > 0).select(F.col(K).alias("project"), F.lit("src/m.ts").alias("node"), F.lit(1.0).alias("score"))
    folders = customers.limit(0).select(F.col(K).alias("project"), F.lit("x").alias("dir"), F.lit("x").alias("purpose"))
    told = cut(formats.items(configs.findings(known, by), commands, configs.frameworks(known, by), ranked, folders, by))
    return formats.texts(formats.fitting(formats.sections(told, by), by, LIMIT), by)
