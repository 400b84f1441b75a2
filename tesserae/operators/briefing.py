"""Briefings: findings, commands and core files as prioritised sections, and answers to standing questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import top_dir
from ..functions.text import tokens
from . import report, rules

# The order of sections of a short briefing by style, our own; whole files in the formats' orders are made by formats.
FORMATS = {
    "claude": ("commands", "critical", "core_modules", "stack", "conventions", "supplementary"),
    "cursor": ("critical", "commands", "core_modules", "conventions", "stack", "supplementary"),
    "copilot": ("stack", "commands", "conventions", "critical", "core_modules", "supplementary"),
    "agents": ("commands", "critical", "core_modules", "conventions", "stack", "supplementary"),
}
# Headers of a briefing's sections.
HEADERS = {"commands": "Commands", "critical": "Critical context", "core_modules": "Core modules", "stack": "Stack", "conventions": "Conventions", "supplementary": "Also known"}


def _lines(df: DataFrame, key: str, line: Column, order: Column) -> DataFrame:
    """One section of a line a row, in order; none without rows."""
    rows = df.select(order.alias("o"), line.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("v"))
    body = F.array_join(F.transform("v", lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    return rows.where(F.size("v") > 0).select(F.lit(key).alias("key"), body.alias("body"))


def core_modules(ranked: DataFrame) -> DataFrame:
    """The foremost of ranked (node, score): fifteen of over 500, ten of over 100, else five."""
    n = ranked.count()
    return ranked.orderBy(F.desc("score"), "node").limit(15 if n > 500 else 10 if n > 100 else 5)


def sections(findings: DataFrame, commands: DataFrame, ranked: DataFrame, stack: DataFrame, mode: str = "app", style: str = "claude") -> DataFrame:
    """(pos, key, header, body, priority, tokens) of a briefing.

    findings (category, description, confidence), commands (name, command), ranked (node, score), stack (framework,
    version). Every input is a bounded report by now, so a section is one row.
    """
    held = rules.tiers(findings)
    high = held.where("tier = 'important'")
    text = F.concat_ws(": ", "category", "description")
    parts = [
        _lines(commands, "commands", F.concat_ws(": ", "name", "command"), F.col("name")),
        _lines(held.where("tier = 'critical'"), "critical", text, text),
        _lines(core_modules(ranked), "core_modules", F.col("node"), F.struct(-F.col("score"), "node")),
        _lines(stack, "stack", F.concat_ws(" ", "framework", "version"), F.col("framework")),
        _lines(high, "conventions", text, text),
        _lines(held.where("tier = 'supplementary'"), "supplementary", text, text),
    ]
    order = F.array_position(F.array(*map(F.lit, FORMATS[style])), F.col("key"))
    header = F.element_at(F.create_map(*(F.lit(x) for p in HEADERS.items() for x in p)), F.col("key"))
    rows = reduce(DataFrame.unionByName, parts).select(order.alias("pos"), "key", header.alias("header"), "body")
    return rows.withColumn("priority", rules.section_priority(F.col("key"), F.lit(mode))).withColumn("tokens", tokens(F.length("body")))


def briefing(*inputs: DataFrame, limit: int = 2000, mode: str = "app", style: str = "claude") -> DataFrame:
    """The sections that fit the budget, in their order."""
    return report.budget(sections(*inputs, mode=mode, style=style), limit).orderBy("pos")


def strength_label(score: Column) -> Column:
    return F.when(score >= 0.5, "high").when(score >= 0.3, "moderate").otherwise("low")


def pressing(cycles: DataFrame, hubs: DataFrame, fragile: DataFrame, pairs: DataFrame, orphans: DataFrame, reverts: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """(priority, question, n, example): what to look at first, most urgent on top; questions without cause are left out."""

    def ask(df: DataFrame, priority: int, question: str, example: Column, best: Column) -> DataFrame:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.min_by(example, best).alias("example")).where("n > 0")
        return row.select(F.lit(priority).alias("priority"), F.lit(question).alias("question"), "n", "example")

    parts = [
        ask(cycles, 1, "which imports form cycles", F.col("path"), F.struct("length", "path")),
        ask(hubs, 2, "what do most files depend on", F.col("node"), F.struct(-F.col("edges"), "node")),
        ask(fragile, 3, "what is edited again and again", F.col("node"), F.struct(-F.col("n"), "node")),
        ask(pairs, 4, "what changes together unseen", F.concat_ws(" + ", "a", "b"), F.struct(-F.col("strength"), "a", "b")),
        ask(orphans, 5, "what does nobody use", F.col("node"), F.col("node")),
    ]
    if reverts is not None:
        parts.append(reverts.select(F.lit(6).alias("priority"), F.lit("what was rolled back").alias("question"), F.col("total").alias("n"), F.get("named", F.lit(0)).alias("example")))
    if tests is not None:
        parts.append(ask(tests, 7, "what has a test that must change too", F.col("item"), F.col("item")))
    return reduce(DataFrame.unionByName, parts).orderBy("priority")


def file_questions(asked: DataFrame, findings: DataFrame, matches: DataFrame) -> DataFrame:
    """(item, priority, question, n, example): what to know before a file (item) is edited, most urgent on top.

    findings (id, category, description), matches (id, path) of findings and the files that they speak of. Four kinds
    need a finding about the file; anti-patterns and conventions concern every file; activity concerns a top-level folder.
    Of each kind the finding of the least id is the example.
    """
    about = {"Core modules": (1, "is it a hub"), "Circular dependencies": (2, "is it part of a cycle"), "Fragile code": (3, "is it hard to get right"), "Hidden dependencies": (4, "what changes with it unseen")}
    items = asked.select("item").distinct()
    table = F.create_map(*(F.lit(x) for c, v in about.items() for x in (c, F.struct(F.lit(v[0]).alias("priority"), F.lit(v[1]).alias("question")))))
    own = findings.where(F.col("category").isin(*about)).join(matches.select("id", F.col("path").alias("item")).distinct(), "id").join(items, "item", "left_semi")
    own = own.withColumn("q", F.element_at(table, F.col("category"))).groupBy("item", "q.priority", "q.question").agg(F.count(F.lit(1)).alias("n"), F.min_by("description", "id").alias("example"))
    c = F.col("category")
    everywhere = [(c == "Anti-patterns", 5, "what was tried and given up"), (c.rlike("[cC]onvention|Import|TypeScript|[pP]attern") & (c != "Anti-patterns"), 6, "which conventions hold")]
    sums = [findings.where(w).agg(F.count(F.lit(1)).alias("n"), F.min_by("description", "id").alias("example")).where("n > 0").select(F.lit(p).alias("priority"), F.lit(q).alias("question"), "n", "example") for w, p, q in everywhere]
    general = items.crossJoin(F.broadcast(reduce(DataFrame.unionByName, sums)))  # two rows at most
    busy = findings.where(c == "Active development").select("id", "description", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(r"[\w.@-]+"), F.lit(0)))).alias("top"))
    active = items.withColumn("top", top_dir(F.col("item"))).join(busy, "top").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min_by("description", "id").alias("example"))
    active = active.select("item", F.lit(7).alias("priority"), F.lit("is its folder in motion").alias("question"), "n", "example")
    return own.unionByName(general.select("item", "priority", "question", "n", "example")).unionByName(active)


def without_front_matter(text: Column) -> Column:
    """A text without the block between two lines of dashes that it opens with."""
    return F.regexp_replace(text, r"^(?s)---\n.*?\n---\n", "")


def command_lines(commands: DataFrame, verbose: bool = False) -> DataFrame:
    """(name, line) of commands (name, command) that are set and, unless verbose, aren't given away by the files."""
    rows = commands.where(F.col("command").isNotNull() & (F.lit(verbose) | ~rules.told(F.col("command"))))
    return rows.select("name", F.concat(F.lit("- "), "name", F.lit(": `"), "command", F.lit("`")).alias("line"))
