"""A scan of a repository, composed of the operators: lazy tables, each worked out when it is asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import assoc, changes, configs, context, extract, findings, graph, history, patterns, report, resolve, rules, tools, windows

LANGUAGES = {"script": (r"\.(tsx?|jsx?)$", extract.script_imports, resolve.script), "python": (r"\.py$", extract.python_imports, resolve.python), "rust": (r"\.rs$", extract.rust_imports, resolve.rust)}


def import_edges(files: DataFrame, module: str | None = None) -> DataFrame:
    """(src, dst) of all imports between files (path, content); the modules of Go are those that files declare, or the one named."""
    sources = files.where(rules.is_graph_source(F.col("path")))

    def specs(pattern: str, found) -> DataFrame:
        return sources.where(F.col("path").rlike(pattern)).select(F.col("path").alias("src"), F.explode(found(F.coalesce("content", F.lit("")))).alias("spec"))

    out = None
    for pattern, found, to in LANGUAGES.values():
        part = to(specs(pattern, found), sources).select("src", "dst")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(resolve.go(specs(r"\.go$", extract.go_imports), sources, module or resolve.go_modules(files)).select("src", "dst"))


def project(files: DataFrame, commits: DataFrame, commit_files: DataFrame, module: str | None = None, mode: str | None = None, shallow: bool = False) -> dict[str, DataFrame]:
    """The tables of a scan, findings among them: what rules tell of files, configurations, imports and history, judged together.

    files (path, content), commits (commit_id, ts, subject), commit_files (commit_id, ts, subject, status, path). Ranks
    are those of production files. Without a mode, the files tell it (one row is fetched). A shallow copy with little history
    gives one notice in place of what history tells.
    """
    p = F.col("path")
    sources = files.where(rules.is_graph_source(p))
    edges = windows.cut(import_edges(files, module))  # many tables read them
    production = sources.where(paths.is_production(p)).select(p.alias("node"))
    inner = edges.join(production.select(F.col("node").alias("src")), "src", "left_semi").join(production.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    node = F.col("node")
    lost = tools.gated_orphans(graph.orphans(production, edges, paths.is_entry_point(node) | node.endswith(".d.ts")))
    known = configs.facts(files.withColumn("_scan", F.lit(0)), ["_scan"])
    frameworks = configs.frameworks(known, ["_scan"])
    found_mode = configs.modes(files.withColumn("_scan", F.lit(0)), frameworks, ["_scan"]).select("mode")
    mode = mode or (found_mode.first() or ["app"])[0]
    tables = {
        "files": files,
        "languages": files.select(paths.language(p).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files")),
        "frameworks": frameworks.drop("_scan"),
        "mode": files.sparkSession.range(1).select(F.lit(mode).alias("mode")),
        "edges": edges,
        "hubs": graph.hubs(edges.join(sources.where(paths.is_test(p)).select(p.alias("src")), "src", "left_anti").select("src", "dst"), sources=sources),
        "ranks": graph.pagerank(production, inner),
        "cycles": graph.cycles(inner),
        "orphans": lost,
        "patterns": patterns.dominant(files, mode),
        "conventions": patterns.decisions(rules.conventions(files), mode),
        "structure": rules.structure(files),
        "commands": rules.fallback_commands(files, rules.build_commands(files.where(p == "package.json").select(F.lit(0).alias("pos"), "content"))),
        "aliases": patterns.path_aliases(files.where(p == "tsconfig.json")),
        "generated": rules.generated(files),
        "environment": patterns.env_vars(files),
        "pairs": history.pairs(commit_files),
        "coupling": history.coupling(commit_files, edges),
        "churn": history.churn(commit_files),
        "areas": history.areas(commit_files),
        "rapid": history.rapid(commit_files),
        "reverts": history.reverts(commits),
        "given_up": history.anti_patterns(commits, commit_files),
        "scopes": history.conventions(commits),
    }
    tables["findings"] = told(tables, known, mode, history.enough(commits, shallow))
    return tables


def told(scan: dict[str, DataFrame], known: DataFrame, mode: str, enough: bool) -> DataFrame:
    """The findings of a scan, by stage: configurations, mode, contents (judged by ranks and areas), history, imports."""
    none = F.array().cast("array<string>")
    listed = configs.findings(known, ["_scan"]).select("category", "name", "description", "confidence", F.lit(0).cast("long").alias("n"), none.alias("paths"))
    busy = scan["areas"] if enough else scan["areas"].limit(0)
    past = findings.of_history(scan["reverts"], scan["given_up"], scan["scopes"], scan["areas"], scan["rapid"], scan["coupling"]) if enough else findings.shallow(listed)
    front = graph.facades(scan["edges"], scan["hubs"], F.col("src").rlike(r"(^|/)__init__\.py$"), paths.dirname(F.col("node")))
    parts = {
        "configuration": listed,
        "mode": findings.of_mode(scan["mode"]),
        "contents": findings.validated(findings.of_patterns(scan["files"], mode), scan["ranks"], busy).select(*findings.COLUMNS),
        "history": past,
        "imports": findings.of_graph(scan["hubs"], scan["cycles"], scan["orphans"], front),
    }
    return reduce(DataFrame.unionByName, (rows.withColumn("stage", F.lit(stage)) for stage, rows in parts.items()))


def check(scan: dict[str, DataFrame], modified: DataFrame) -> DataFrame:
    """What a set of changes (item, idx) leaves out, by a scan: partners, importers of widely used files, tests."""
    tests = context.test_candidates(modified, scan["files"])
    return changes.completeness(modified, assoc.partners(scan["pairs"]), scan["edges"], tests)


def file_companions(scan: dict[str, DataFrame], primary: DataFrame) -> DataFrame:
    """The companions of files (item), by a scan."""
    return changes.companions(context.file_signals(primary, assoc.partners(scan["pairs"]), scan["edges"], scan["files"]))


def update(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """A report (header, body, pos) made anew, with the sections that were written into the old one by hand."""
    return report.merge(fresh, existing)


def difference(fresh: DataFrame, existing: DataFrame, text: str) -> DataFrame:
    """(side, line, n): lines that only the new text has (+), and only the old one (-)."""
    plus, minus = report.new_lines(fresh, existing, text), report.new_lines(existing, fresh, text)
    return plus.select(F.lit("+").alias("side"), "line", "n").unionByName(minus.select(F.lit("-").alias("side"), "line", "n"))
