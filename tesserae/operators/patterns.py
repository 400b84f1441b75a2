"""Dominant patterns: eight families, voted on by how many files show each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths, text
from . import vote


def shown(path: Column, body: Column, family: str | None = None) -> Column:
    """The (family, name) of the patterns that a text without comments shows, as an array; none where body is null.

    Files vote only in the sets of paths.is_voted and is_read_for_tests. A text meets one alternation a family first, and the
    patterns one by one only where that holds.
    """
    rules: dict[str, list[tuple[str, str, str]]] = {}
    for f, name, regex, scope in fixed.PATTERNS:
        if family in (None, f):
            rules.setdefault(f, []).append((name, regex, scope))
    none = F.array().cast("array<struct<family:string,name:string>>")
    found = []
    for f, of in rules.items():
        each = F.array(*(F.when(body.rlike(regex) & (path.rlike(scope) if scope else F.lit(True)), F.struct(F.lit(f).alias("family"), F.lit(name).alias("name"))) for name, regex, scope in of))
        read = paths.is_read_for_tests(path) if f == "test" else paths.is_voted(path)
        found.append(F.when(read & body.rlike("|".join(f"(?:{regex})" for _, regex, _ in of)), F.filter(each, lambda x: x.isNotNull())).otherwise(none))
    return F.concat(*found)


def body(path: Column, content: Column) -> Column:
    """The text that votes: without comments; null for files that have no vote. Give it a projection of its own before shown()."""
    return F.when(paths.is_voted(path) | paths.is_read_for_tests(path), text.strip_comments(F.coalesce(content, F.lit(""))))


def hits(files: DataFrame, family: str | None = None) -> DataFrame:
    """(family, name, path): the patterns that each file (path, content) shows; one scan for all, and no row without a match."""
    rows = files.select("path", body(F.col("path"), F.col("content")).alias("body"))
    return rows.select("path", F.explode(shown(F.col("path"), F.col("body"), family)).alias("v")).select("v.*", "path")


def tally(files: DataFrame, family: str | None = None) -> DataFrame:
    """(family, name, n): how many of files (path, content) show each pattern that any shows."""
    return hits(files, family).groupBy("family", "name").agg(F.count(F.lit(1)).alias("n"))


def corroborated(files: DataFrame) -> DataFrame:
    """(local): whether paths or manifests speak of translation, without which a bare t("...") says nothing."""
    p = F.col("path")
    paths = p.contains("locale") | p.contains("i18n") | p.contains("translations") | p.contains("messages/")
    package = p.endswith("package.json") & F.coalesce(F.col("content").rlike("i18next|react-intl|next-intl|@lingui"), F.lit(False))
    return files.agg(F.coalesce(F.bool_or(paths | package), F.lit(False)).alias("local"))


def runner(files: DataFrame) -> DataFrame:
    """(runner): the test runner that the root manifest names, else what files import or lie at the root; null if unknown."""
    root = F.max(F.when(F.col("path") == "package.json", F.col("content")))
    node = F.bool_or(F.col("path").rlike("test|spec") & F.coalesce(F.col("content").rlike(r"""(require\(|from\s+)['"]node:test['"]"""), F.lit(False)))
    at_root = [F.bool_or(F.col("path").rlike(regex)) for _, regex in fixed.RUNNER_FILES]
    row = files.agg(root.alias("m"), node.alias("node"), *(x.alias(f"r{k}") for k, x in enumerate(at_root)))
    out = F.lit(None).cast("string")
    for k in reversed(range(len(at_root))):
        out = F.when(F.col(f"r{k}"), fixed.RUNNER_FILES[k][0]).otherwise(out)
    out = F.when(F.col("node"), fixed.RUNNERS[-1][0]).otherwise(out)
    for name, regex in reversed(fixed.RUNNERS):
        out = F.when(F.col("m").rlike(regex), name).otherwise(out)
    return row.select(out.alias("runner"))


def dominant(files: DataFrame, mode: str = "app", family: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(family, name, n): the pattern most files show in each family that has enough of them; ties go to the smaller name.

    A bare t("...") needs corroboration; script tests take their runner's name and go without one; pytest needs five
    primary Python files. A family without a winner hinders no other. counts: those of tally(), if they are at hand.
    """
    least = fixed.LEAST | ({"router": fixed.LIBRARY_ROUTERS} if mode == "library" else {})
    counts = tally(files, family) if counts is None else counts
    if family in (None, "i18n"):
        counts = counts.crossJoin(F.broadcast(corroborated(files))).where((F.col("name") != 't("key")') | F.col("local")).drop("local")
    best = vote.dominant(counts, least)
    if family in (None, "test"):
        primary = F.col("path").endswith(".py") & ~F.col("path").rlike(r"(test[s_]?/|bench/|scripts?/|docs[_/]|examples?/|fixtures?/)") & ~F.col("path").startswith(".")
        facts = runner(files).crossJoin(F.broadcast(files.agg(F.count_if(primary).alias("primary"))))  # one row each
        best = best.crossJoin(F.broadcast(facts)).where((F.col("name") != "pytest") | (F.col("primary") >= 5))
        best = best.select("family", F.when(F.col("name") == "script tests", F.col("runner")).otherwise(F.col("name")).alias("name"), "n").where("name IS NOT NULL")
    return best.select("family", "name", "n")


def label(description: Column) -> Column:
    """The short label of a dominant pattern's description; null if none fits."""
    out = F.lit(None).cast("string")
    for name, regex in reversed(fixed.LABELS):
        hit = description.rlike(regex)
        out = F.when(hit & ~description.contains("integration") if name == "auth" else hit, name).otherwise(out)
    return out


def quick_reference(findings: DataFrame, verbose: bool = False) -> DataFrame:
    """(label, text): the first dominant pattern (pos, category, description, confidence) of each label, shortened."""
    told = ("testing", "validation", "styling", "database", "data fetching", "components")
    rows = findings.where((F.col("category") == "Dominant patterns") & (F.col("confidence") != "low"))
    short = F.regexp_replace(F.col("description"), r"\. (Follow this pattern|This is the project's standard|Each integration has).*$", "")
    rows = rows.select("pos", label(F.col("description")).alias("label"), short.alias("text")).where("label IS NOT NULL")
    rows = rows if verbose else rows.where(~F.col("label").isin(*told))
    return rows.groupBy("label").agg(F.min_by("text", "pos").alias("text"))


def env_vars(files: DataFrame) -> DataFrame:
    """(name, kind): the environment variables that texts read: public, private, or neither (NODE_ENV)."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(r), F.lit(1)) for r in (r"process\.env\.([A-Za-z0-9_]+)", r"import\.meta\.env\.([A-Za-z0-9_]+)")))
    names = files.select(F.explode(found).alias("name")).distinct()
    public = F.lit(False)
    for p in fixed.PUBLIC_PREFIXES:
        public = public | F.col("name").startswith(p)
    return names.withColumn("kind", F.when(public, "public").when(F.col("name").startswith("NODE_ENV"), "neither").otherwise("private"))


def path_aliases(configs: DataFrame) -> DataFrame:
    """(alias): the distinct path aliases of compiler configurations (content); malformed ones have none."""
    parsed = F.from_json("content", "compilerOptions struct<paths:map<string,array<string>>>")["compilerOptions"]["paths"]
    return configs.select(F.explode(F.map_keys(parsed)).alias("alias")).select(F.regexp_replace("alias", r"/\*$", "").alias("alias")).distinct()


def go_module(content: Column) -> Column:
    name = F.regexp_extract(content, r"(?m)^module\s+(\S+)", 1)
    return F.when(name != "", name)


def decisions(counts: DataFrame, mode: str = "app") -> DataFrame:
    """(convention) that counts (name, n) of conventions decide; libraries choose their exports, so these say nothing there."""
    row = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"))  # a handful of names
    n = lambda name: F.coalesce(F.col("m")[name], F.lit(0))
    exports = n("default exports") + n("named exports")
    rules = [
        ("imports by alias", (n("alias imports") + n("relative imports") > 10) & (n("alias imports") > 2 * n("relative imports"))),
        ("barrel files", (n("index files") >= 3) & (n("barrels") >= 3)),
        ("error classes", n("error classes") >= 2),
        ("named exports", F.lit(mode != "library") & (exports > 10) & (n("named exports") > 3 * n("default exports"))),
        ("default exports", F.lit(mode != "library") & (exports > 10) & (n("default exports") > 2 * n("named exports"))),
        ("package barrels", (n("python files") >= 3) & (n("package barrels") >= 3)),
        ("wrapped errors", (n("go files") >= 3) & (n("wrapped errors") > 5) & (n("wrapped errors") > 0.3 * n("error checks"))),
        ("interfaces first", (n("go files") >= 3) & (n("interfaces") >= 5)),
    ]
    return row.select(F.explode(F.filter(F.array(*(F.when(c, F.lit(x)) for x, c in rules)), lambda x: x.isNotNull())).alias("convention"))
