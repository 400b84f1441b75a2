"""Instruction files in four formats for any number of projects, as one grouped, ordered assembly.

What goes into the files are items (by, key, name, text, o): commands, findings by tier, frameworks, core files. A layout, one
row for each format and section, says the header, the order, the priority and how an item is written. Items meet the layout
by key, lines are gathered by project, format and section, sections are dropped by priority until the rest fits the budget,
and what is kept is joined to a text. Sections that a stored file holds and nobody generates are put back by merged().
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from . import patterns, report, rules


class Section(NamedTuple):
    """Of a format: a section's key, header, priority (None: that of the mode), and how its items are written."""

    format: str
    key: str
    header: str
    priority: int | None
    style: str
    told: bool = True  # whether it is shown where nothing more is asked for


# File names, headers, orders and priorities of the formats.
FILES = {"claude": "CLAUDE.md", "agents": "AGENTS.md", "copilot": ".github/copilot-instructions.md", "cursor": ".cursor/rules/project.mdc"}
LAYOUT = [
    Section("claude", "header", "# CLAUDE.md", 100, "fixed"), Section("claude", "quick_reference", "## Quick Reference", None, "labelled"), Section("claude", "commands", "## Commands", 95, "bold command"),
    Section("claude", "critical", "## Critical Constraints", None, "bold"), Section("claude", "stack", "## Stack", None, "list", False), Section("claude", "structure", "## Project Structure", None, "folder", False),
    Section("claude", "core_modules", "## Core Modules (by structural importance)", None, "code"), Section("claude", "conventions", "## Conventions & Patterns", None, "grouped"),
    Section("claude", "supplementary", "## Additional Context", None, "grouped"), Section("claude", "check", "## Before Making Changes", 91, "plain"), Section("claude", "footer", "## What to Add Manually", 90, "fixed"),
    Section("agents", "header", "# AGENTS.md", 100, "fixed"), Section("agents", "commands", "## Commands", 95, "bold command"), Section("agents", "critical", "## Constraints", 90, "bold"), Section("agents", "stack", "## Stack", 50, "list", False),
    Section("agents", "core_modules", "## Core Modules (by structural importance)", 60, "code"), Section("agents", "conventions", "## Conventions", 30, "bold"), Section("agents", "supplementary", "## Additional Context", 20, "plain"),
    Section("agents", "footer", "## What to Add Manually", 10, "fixed"),
    Section("copilot", "header", "# Copilot Instructions", 100, "fixed"), Section("copilot", "commands", "## Development Commands", 95, "command"), Section("copilot", "critical", "## Important Constraints", 90, "plain"),
    Section("copilot", "stack", "## Technology Stack", 50, "list"), Section("copilot", "core_modules", "## High-Impact Files", 60, "code"), Section("copilot", "conventions", "## Code Conventions", 30, "plain"), Section("copilot", "supplementary", "## Additional Notes", 20, "plain"),
    Section("cursor", "header", "---\nalwaysApply: true\n---", 100, "fixed"), Section("cursor", "commands", "## Commands", 95, "known command"), Section("cursor", "critical", "## Constraints", 90, "plain"), Section("cursor", "stack", "## Stack", 50, "list"),
    Section("cursor", "core_modules", "## Core Modules", 60, "code"), Section("cursor", "conventions", "## Conventions", 30, "plain"), Section("cursor", "supplementary", "## Additional Context", 20, "plain"),
]
NAMED = ("dev", "build", "test", "lint")
# What the fixed sections say, in our own words.
SAYS = {"header": "What to know before working here. Generated; edit freely.", "footer": "What only people know: decisions, incidents, terms, and what to avoid."}
CHECKS = {"core_modules": "Files listed as core affect many others.", "conventions": "Follow the conventions listed above.", "critical": "Respect the constraints listed above."}


def items(findings: DataFrame, commands: DataFrame, frameworks: DataFrame, ranked: DataFrame, folders: DataFrame, by: list[str], verbose: bool = False) -> DataFrame:
    """(by, key, name, text, o) of what projects tell.

    findings (category, description, confidence), commands (name, command), frameworks (framework), ranked (node, score) and folders
    (dir, purpose), each with the columns of by. Core files are fifteen of over 500, ten of over 100, else five.
    """
    none = F.lit(None).cast("string")
    row = lambda df, key, name, text, order: df.select(*by, key.alias("key"), name.alias("name"), text.alias("text"), order.cast("string").alias("o"))
    held = rules.tiers(findings.select(*by, "category", "description", "confidence"))
    key = F.when(F.col("tier") == "important", "conventions").otherwise(F.col("tier"))
    told = row(held, key, F.col("category"), F.col("description"), F.concat_ws("\x1f", "category", "description"))
    given = commands.where(F.col("command").isNotNull() & (F.lit(verbose) | ~rules.told(F.col("command"))) & (F.col("name") != "start"))
    first = F.array_position(F.array(*map(F.lit, NAMED)), F.col("name"))
    order = F.concat(F.when(first > 0, first).otherwise(9).cast("string"), F.col("name"))
    ranks = Window.partitionBy(*by).orderBy(F.desc("score"), "node")
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    core = ranked.withColumn("r", F.row_number().over(ranks)).where("r <= 15").join(sizes, by).where(F.col("r") <= F.when(F.col("n") > 500, 15).when(F.col("n") > 100, 10).otherwise(5))
    short = F.regexp_replace(F.col("description"), r"\. (Follow this pattern|This is the project's standard|Each integration has).*$", "")
    quick = findings.where((F.col("category") == "Dominant patterns") & (F.col("confidence") != "low")).withColumn("label", patterns.label(F.col("description")))
    enough = quick.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*by)
    seen = ("testing", "validation", "styling", "database", "data fetching", "components")
    quick = quick.where("label IS NOT NULL").where(F.lit(verbose) | ~F.col("label").isin(*seen)).join(enough, by, "left_semi").groupBy(*by, "label").agg(F.min(short).alias("text"))
    hidden = ("src", "public", "node_modules", "dist", "build")
    out = told.unionByName(row(given, F.lit("commands"), F.col("name"), F.col("command"), order))
    out = out.unionByName(row(frameworks, F.lit("stack"), none, F.col("framework"), F.col("framework"))).unionByName(row(core, F.lit("core_modules"), none, F.col("node"), F.lpad(F.col("r").cast("string"), 2, "0")))
    out = out.unionByName(row(quick, F.lit("quick_reference"), F.col("label"), F.col("text"), F.col("label")))
    return out.unionByName(row(folders.where(F.col("purpose").isNotNull() & ~F.col("dir").isin(*hidden)), F.lit("structure"), F.col("dir"), F.col("purpose"), F.col("dir")))


def _line(style: Column) -> Column:
    """An item as it is written in a section of that style; null where it isn't."""
    name, text = F.col("name"), F.col("text")
    capital = F.when(name.isin(*NAMED), F.initcap(name)).otherwise(name)
    forms = {
        "bold command": F.concat(F.lit("- **"), capital, F.lit(":** `"), text, F.lit("`")), "command": F.concat(F.lit("- "), capital, F.lit(": `"), text, F.lit("`")),
        "known command": F.when(name.isin(*NAMED), F.concat(F.lit("- "), capital, F.lit(": `"), text, F.lit("`"))), "bold": F.concat(F.lit("- **"), name, F.lit(":** "), text),
        "labelled": F.concat(F.lit("- **"), name, F.lit(":** "), text), "plain": F.concat(F.lit("- "), text), "code": F.concat(F.lit("- `"), text, F.lit("`")), "list": text, "grouped": text,
        "folder": F.concat(F.lit("- `"), name, F.lit("/`: "), text),
    }
    out = F.lit(None).cast("string")
    for k, v in forms.items():
        out = F.when(style == k, v).otherwise(out)
    return out


def sections(told: DataFrame, by: list[str], mode: DataFrame | str = "app", formats: list[str] | None = None, verbose: bool = False) -> DataFrame:
    """(by, format, pos, key, header, body, priority, tokens) of the files of items told; mode is a name, or a table (by, mode)."""
    kept = [s for s in LAYOUT if (formats is None or s.format in formats) and (verbose or s.told)]
    rows = [(s.format, k, s.key, s.header, s.priority, s.style) for k, s in enumerate(kept)]
    layout = told.sparkSession.createDataFrame(rows, "format string, pos int, key string, header string, priority int, style string")
    projects = told.select(*by).distinct()
    shown = told.select(*by, "key").distinct()
    checks = shown.where(F.col("key").isin(*CHECKS)).select(*by, F.lit("check").alias("key"), F.lit(None).cast("string").alias("name"), F.element_at(F.create_map(*(F.lit(x) for p in CHECKS.items() for x in p)), F.col("key")).alias("text"), F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(CHECKS) for x in (c, str(k)))), F.col("key")).alias("o"))
    useful = shown.where(F.col("key").isin("core_modules", "conventions")).select(*by).distinct()
    lines = told.unionByName(checks.join(useful, by, "left_semi")).join(F.broadcast(layout), "key").withColumn("line", _line(F.col("style"))).where("line IS NOT NULL")
    place = [*by, "format", "pos", "key", "header", "priority", "style"]
    # One category is a line by itself, several findings of it are a list below its name.
    grouped = lines.where("style = 'grouped'").groupBy(*place, "name").agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("v"))
    many = F.concat(F.lit("- **"), "name", F.lit(":**\n"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("  - "), x["line"])), "\n"))
    grouped = grouped.select(*place, F.col("name").alias("o"), F.when(F.size("v") > 1, many).otherwise(F.concat(F.lit("- **"), "name", F.lit(":** "), F.get("v", F.lit(0))["line"])).alias("line"))
    lines = lines.where("style <> 'grouped'").select(*place, "o", "line").unionByName(grouped)
    held = lines.groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("v"))  # a report's lines: some dozens
    bodies = held.select(*place, F.when(F.col("style") == "list", F.array_join("v", ", ")).otherwise(F.array_join("v", "\n")).alias("body"))
    says = F.element_at(F.create_map(*(F.lit(x) for p in SAYS.items() for x in p)), F.col("key"))
    still = projects.crossJoin(F.broadcast(layout.where("style = 'fixed'"))).select(*place, says.alias("body"))  # a handful of rows
    out = bodies.unionByName(still)
    if isinstance(mode, str):
        out = out.withColumn("mode", F.lit(mode))
    else:
        out = out.join(mode.select(*by, "mode"), by, "left")
    priority = F.coalesce("priority", rules.section_priority(F.col("key"), F.col("mode")))
    return out.select(*by, "format", "pos", "key", "header", "body", priority.alias("priority"), tokens(F.length("header") + F.length("body") + 3).alias("tokens"))


def fitting(parts: DataFrame, by: list[str], limit: int, keep: int = 90) -> DataFrame:
    """The sections of each project and format that fit: the least important go while the others are over the limit."""
    place = Window.partitionBy(*by, "format")
    before = F.coalesce(F.sum("tokens").over(place.orderBy("priority", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("over", F.sum("tokens").over(place) - before > limit)
    return rows.where(~F.col("over") | (F.col("priority") >= keep)).drop("over")


def texts(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, format, text): sections joined in their order."""
    part = F.struct("pos", F.concat("header", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n")
    return parts.groupBy(*by, "format").agg(whole.alias("text"))  # a file: within its budget


def merged(parts: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """sections with those of stored files (by, format, text) that nobody generates: before the marker, or at the end."""
    keyed = stored.select(F.struct(*by, "format").alias("file"), F.col("text").alias("old"))
    own = report.manual(report.sections(keyed, "file", "old"), fixed.OWN_HEADERS).select("file.*", "pos", "header", "body")
    ends = parts.groupBy(*by, "format").agg(F.coalesce(F.min(F.when(F.col("header") == f"## {fixed.MARKER}", F.col("pos"))), F.max("pos") + 1).alias("at"))
    put = own.join(ends, [*by, "format"]).select(*by, "format", (F.col("at") - 0.5 + F.col("pos") * 1e-6).alias("pos"), F.lit("manual").alias("key"), F.concat(F.lit("## "), "header").alias("header"), F.regexp_replace("body", r"^\n+|\n+$", "").alias("body"), F.lit(100).alias("priority"), F.lit(0).cast("long").alias("tokens"))
    return parts.withColumn("pos", F.col("pos").cast("double")).unionByName(put)


def write(files: DataFrame, path: str) -> None:
    """One folder of Parquet files for each format, which later reads of a single format are pruned to."""
    files.write.mode("overwrite").partitionBy("format").parquet(path)
