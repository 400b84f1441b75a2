"""Findings as the product of a scan: what the rules say of files, with evidence, then judged by structure and history.

A finding is (category, name, description, confidence, n, paths): how many files show it, and the first of them by path. All
files are read once; what they match are rows (rule, path), cut, because they are counted and ranked. Evidence is a
bounded aggregate: row numbers up to k within a rule are taken in each partition before the exchange and once more
after it, so no task ever holds all files of a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import dirname, top_dir
from . import patterns, rules, vote
from .windows import cut

K, TOP = 20, 20
COLUMNS = ("category", "name", "description", "confidence", "n", "paths")
# What a dominant pattern of each family is called.
SAID = {
    "i18n": "User-facing text goes through", "router": "API endpoints use", "schema": "Validation schemas are written with", "state": "Data fetching and state use",
    "test": "Tests use", "auth": "Auth uses", "style": "Styling uses", "database": "Database access uses",
}
# What each convention asks for: category, description, confidence.
CONVENTIONS = {
    "barrel files": ("Import conventions", "Index files re-export: import from the folder", "high"),
    "imports by alias": ("Import conventions", "Path aliases are preferred to relative imports", "high"),
    "error classes": ("Error handling", "Errors have classes of their own", "medium"),
    "named exports": ("Export conventions", "Named exports are preferred to default ones", "high"),
    "default exports": ("Export conventions", "Default exports are preferred", "medium"),
    "package barrels": ("Python conventions", "Packages re-export: import from the package", "high"),
    "wrapped errors": ("Go conventions", "Errors are wrapped with %w", "high"),
    "interfaces first": ("Go conventions", "Interfaces are defined first", "medium"),
}


def least(rows: DataFrame, by: list[str], key: str, k: int = K) -> DataFrame:
    """(by, n, paths): how many rows each group has, and its k least keys in order. rows are read twice: give a cut table."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    top = rows.select(*by, key).withColumn("_r", rank).where(F.col("_r") <= k)
    gathered = top.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("paths"))  # k at most
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(gathered, by)


def finding(category: Column | str, name: Column, description: Column, confidence: Column | str, n: Column | None = None, paths: Column | None = None) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    return [x.alias(c) for c, x in zip(COLUMNS, (lit(category), name, description, lit(confidence), (F.lit(0) if n is None else n).cast("long"), none if paths is None else paths), strict=True)]


def places(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(family, name, place): where the things that a dominant pattern deals with are; the first file by path.

    Translations (English first), schemas of the database layer, helpers of tests, the tokens of a styling configuration, and of
    authentication the guards that show the pattern.
    """
    p = F.col("path")
    mine = ~p.contains("node_modules")
    local = p.rlike(r"locale|i18n|translations|messages") & p.rlike(r"\.(json|ts|js)$") & mine
    first = lambda c: F.min(F.when(c, p))
    found = [("i18n", None, F.coalesce(first(local & p.rlike(r"en[/.]")), first(local)))]
    found += [("database", name, first(p.contains(hint) & mine)) for name, hint in fixed.SCHEMA_PLACES.items()]
    found += [("test", None, first(p.rlike("test-utils|testUtils|fixtures|helpers") & p.rlike("test|spec")))]
    found += [("style", "Tailwind CSS", first(p.contains("tailwind.config") & F.coalesce(F.col("content").rlike("colors|extend"), F.lit(False))))]
    row = files.agg(*(x.alias(f"p{k}") for k, (_, _, x) in enumerate(found)))
    table = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(n).cast("string").alias("name"), F.col(f"p{k}").alias("place")) for k, (f, n, _) in enumerate(found)))
    told = row.select(F.explode(table).alias("v")).select("v.*")
    guard = p.rlike("middleware|guard|auth/index") & p.rlike("auth|middleware|guard|session") & p.rlike(r"\.(ts|tsx|js|py)$") & ~p.contains(".test.")
    return told.unionByName(hits.where((F.col("family") == "auth") & guard).groupBy("family", "name").agg(F.min("path").alias("place"))).where("place IS NOT NULL")


def dominant(files: DataFrame, mode: str = "app") -> DataFrame:
    """A finding for each family of patterns that has a winner, with its evidence (i18n: three files, others: twenty; tests: none)."""
    hits = cut(patterns.hits(files))
    best = patterns.dominant(files, mode, counts=hits.groupBy("family", "name").agg(F.count(F.lit(1)).alias("n")))
    shown = least(hits.join(F.broadcast(best.select("family", "name")), ["family", "name"], "left_semi"), ["family", "name"], "path").select("family", "name", "paths")
    rows = best.join(shown, ["family", "name"], "left")
    at = places(files, hits)
    rows = rows.join(F.broadcast(at.where("name IS NOT NULL")), ["family", "name"], "left")
    rows = rows.join(F.broadcast(at.where("name IS NULL").select("family", F.col("place").alias("spot"))), "family", "left")
    said = F.element_at(F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair)), F.col("family"))
    place = F.coalesce("place", "spot")
    description = F.concat(said, F.lit(" "), "name", F.coalesce(F.concat(F.lit("; see "), place), F.lit("")))
    paths = F.when(F.col("family") == "test", F.array().cast("array<string>")).when(F.col("family") == "i18n", F.slice("paths", 1, 3)).otherwise(F.col("paths"))
    return rows.select(*finding("Dominant patterns", F.col("family"), description, "high", F.col("n"), F.coalesce(paths, F.array().cast("array<string>"))))


def by_convention(files: DataFrame, mode: str = "app") -> DataFrame:
    """A finding for each convention that the counts decide."""
    table = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, v in CONVENTIONS.items() for x in (name, v[k]))), F.col("convention"))
    return patterns.decisions(rules.conventions(files), mode).select(*finding(table(0), F.col("convention"), table(1), table(2)))


def of_environment(files: DataFrame) -> DataFrame:
    """Whether an example of the environment is given, and whether variables of both kinds are read."""
    named = files.agg(F.coalesce(F.bool_or(F.col("path").isin(".env.example", ".env.sample")), F.lit(False)).alias("given")).where("given")
    told = named.select(*finding("Environment", F.lit("example"), F.lit("An example of the environment is given: copy it first"), "high"))
    read = patterns.env_vars(files.where(rules.is_program(F.col("path")))).groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "public").alias("open"), F.count_if(F.col("kind") == "private").alias("shut"))
    both = read.where("open > 0 AND shut > 0")
    return told.unionByName(both.select(*finding("Environment", F.lit("variables"), F.concat(F.col("n").cast("string"), F.lit(" variables, of which browsers see "), F.col("open").cast("string")), "medium")))


def of_generated(files: DataFrame, fewest: int = 2) -> DataFrame:
    """Files that must not be edited, two or more."""
    rows = least(cut(rules.generated(files.where(F.col("path").isNotNull())).select(F.lit("generated").alias("name"), "path")), ["name"], "path")
    return rows.where(F.col("n") >= fewest).select(*finding("Critical constraints", F.col("name"), F.concat(F.lit("Generated files, do not edit: "), F.array_join(F.slice("paths", 1, 5), ", ")), "high", F.col("n"), F.col("paths")))


def of_edits(files: DataFrame) -> DataFrame:
    """Where routes (if any routing was found), components and integrations are added."""
    joined = lambda df: df.groupBy().agg(F.array_join(F.array_sort(F.collect_list("dir")), ", ").alias("dirs"), F.count(F.lit(1)).alias("n")).where("n > 0")  # noqa: E731  (three rows)
    out = []
    for kind, said, sure in (("route", "Routes are defined in ", "high"), ("component", "Components are in ", "medium")):
        out.append(joined(rules.edit_points(files, kind)).select(*finding("Dominant patterns", F.lit(f"{kind} folders"), F.concat(F.lit(said), "dirs"), sure)))
    at = rules.integrations(files).select(*finding("Dominant patterns", F.lit("integrations"), F.concat(F.lit("Each integration has a folder in "), "dir"), "high"))
    return reduce(DataFrame.unionByName, [*out, at])


def of_patterns(files: DataFrame, mode: str = "app") -> DataFrame:
    """All findings that the contents and names of files (path, content) give. Routes are pointed out only where a router won."""
    best = cut(dominant(files, mode))  # a row for each family
    routed = best.where("name = 'router'").limit(1)
    edits = of_edits(files)
    edits = edits.where("name <> 'route folders'").unionByName(edits.where("name = 'route folders'").join(routed.select(F.lit("route folders").alias("name")), "name", "left_semi").select(*COLUMNS))
    return reduce(DataFrame.unionByName, [best, by_convention(files, mode), of_environment(files), of_generated(files), edits])


def of_mode(mode: DataFrame) -> DataFrame:
    """A library says so."""
    return mode.where("mode = 'library'").select(*finding("Project structure", F.lit("library"), F.lit("A library: changes to what it exports break others"), "high"))


def of_graph(hubs: DataFrame, cycles: DataFrame, orphans: DataFrame, facades: DataFrame) -> DataFrame:
    """Core modules, cycles, files that nothing imports, and packages that hide their parts."""
    core = hubs.where("rank <= 5").groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "node", "edges"))).alias("h")).where("size(h) > 0")
    told = F.array_join(F.transform("h", lambda h: F.concat(h["node"], F.lit(" ("), h["edges"].cast("string"), F.lit(")"))), ", ")
    out = [core.select(*finding("Core modules", F.lit("hubs"), F.concat(F.lit("Most imported: "), told), "high", F.size("h"), F.transform("h", lambda h: h["node"])))]
    looped = cycles.orderBy("length", "path").limit(5)
    out.append(looped.select(*finding("Circular dependencies", F.col("path"), F.concat(F.lit("Imports go round: "), "path"), "high", F.col("length"))))
    lost = orphans.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n > 0")
    out.append(lost.select(*finding("Dead code candidates", F.lit("orphans"), F.concat(F.col("n").cast("string"), F.lit(" files are not imported, the first of them "), "node"), "medium", F.col("n"))))
    hidden = facades.select(F.col("node").alias("facade"), F.size("members").alias("n"))
    out.append(hidden.select(*finding("Core modules", F.concat(F.lit("facade "), "facade"), F.concat("facade", F.lit(" stands for "), F.col("n").cast("string"), F.lit(" modules beside it")), "high", F.col("n"))))
    return reduce(DataFrame.unionByName, out)


def of_history(reverts: DataFrame, given_up: DataFrame, scopes: DataFrame, areas: DataFrame, rapid: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the history tells: reverts, deletions, conventions of commits, active areas, fragile files, hidden coupling."""
    out = [reverts.select(*finding("Git history", F.lit("reverts"), F.concat(F.col("total").cast("string"), F.lit(" reverted commits; approaches to avoid: "), F.array_join(F.slice("named", 1, 3), "; ")), "high", F.col("total")))]
    rest = F.col("label") == "others"
    tried = F.when(rest, F.concat(F.col("n").cast("string"), F.lit(" more approaches were reverted"))).otherwise(F.concat(F.lit("Tried and reverted: "), "label"))
    gone = F.when(rest, F.concat(F.col("n").cast("string"), F.lit(" more deletions of several files"))).otherwise(F.concat(F.lit("Deleted together: "), F.col("n").cast("string"), F.lit(" files ("), "label", F.lit(")")))
    out.append(given_up.select(*finding("Anti-patterns", F.concat("kind", F.lit(" "), "label"), F.when(F.col("kind") == "reverted", tried).otherwise(gone), F.col("confidence"), F.col("n"))))
    named = scopes.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "scope"))).alias("s"), F.max("share").alias("share")).where("size(s) > 0")
    out.append(named.select(*finding("Commit conventions", F.lit("scopes"), F.concat(F.lit("Conventional subjects; scopes: "), F.array_join(F.transform("s", lambda x: x["scope"]), ", ")), "high")))
    busy = areas.where("n >= 3").groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "dir"))).alias("a")).where("size(a) >= 2")
    out.append(busy.select(*finding("Active development", F.lit("areas"), F.concat(F.lit("Most active: "), F.array_join(F.transform("a", lambda x: x["dir"]), ", ")), "high")))
    fragile = rapid.orderBy(F.desc("n"), "path").limit(3)
    out.append(fragile.select(*finding("Fragile code", F.col("path"), F.concat("path", F.lit(" was edited "), F.col("n").cast("string"), F.lit(" times within a week")), "high", F.col("n"), F.array("path"))))
    bound = pairs.orderBy(F.desc("strength"), "a", "b").limit(3)
    out.append(bound.select(*finding("Hidden dependencies", F.concat("a", F.lit(" + "), "b"), F.concat("a", F.lit(" and "), "b", F.lit(" change together without an import")), "high", F.col("cnt"), F.array("a", "b"))))
    return reduce(DataFrame.unionByName, out)


def shallow(findings: DataFrame) -> DataFrame:
    """The one finding that a shallow copy with little history gives; it ends what is told of the history."""
    one = findings.sparkSession.range(1)
    return one.select(*finding("Git history", F.lit("shallow"), F.lit("A shallow clone: too little history to tell from"), "low"))


def validated(findings: DataFrame, ranks: DataFrame, areas: DataFrame, top: int = TOP) -> DataFrame:
    """findings with the confidence that files, ranks and activity give, and with overlap, dirs and active.

    ranks (node, score): the `top` best count. areas (dir): top-level folders of much change. Both are short lists. Findings
    without evidence keep what they declare.
    """
    best = ranks.orderBy(F.desc("score"), "node").limit(top).select(F.col("node").alias("path"), F.lit(True).alias("hit"))
    busy = areas.select(F.col("dir").alias("top"), F.lit(True).alias("busy")).distinct()
    each = findings.select("category", "name", F.explode("paths").alias("path"))
    each = each.join(F.broadcast(best), "path", "left").withColumn("top", top_dir(F.col("path"))).join(F.broadcast(busy), "top", "left")
    facts = each.groupBy("category", "name").agg(
        F.count("hit").alias("overlap"), F.countDistinct(dirname(F.col("path"))).alias("dirs"), F.coalesce(F.bool_or("busy"), F.lit(False)).alias("active")
    )
    rows = findings.join(facts, ["category", "name"], "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0)), "dirs": F.coalesce("dirs", F.lit(0)), "active": F.coalesce("active", F.lit(False))})
    shown = F.size("paths")
    rows = rows.withColumnRenamed("n", "files").withColumnRenamed("confidence", "declared").withColumn("n", shown)
    rows = rules.revised(vote.evidence(rows, F.col("n"), F.col("overlap"), F.col("active")))
    sure = F.when(F.col("n") == 0, F.col("declared")).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", sure).drop("n", "points").withColumnRenamed("files", "n").select(*COLUMNS, "declared", "overlap", "dirs", "active")
