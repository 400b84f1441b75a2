"""Instruction files of several projects in four formats."""

import pytest

from tesserae.operators import formats


def told(spark, verbose=False):
    f = [("p", "Hidden dependencies", "types.ts and utils.ts change together", "high"), ("p", "Style", "tabs", "high"), ("p", "Style", "no tabs", "high"), ("p", "Naming", "short", "high"), ("p", "Misc", "maybe", "medium"), ("p", "Misc", "unlikely", "low"),
         ("p", "Dominant patterns", "API endpoints use Hono", "high"), ("p", "Dominant patterns", "Auth uses Clerk", "high"), ("q", "Misc", "alone", "medium")]
    make = spark.createDataFrame
    return formats.items(
        make(f, "project string, category string, description string, confidence string"),
        make([("p", "dev", "vite"), ("p", "test", "pytest"), ("p", "db:seed", "seed"), ("p", "lint", "eslint"), ("q", "start", "x")], "project string, name string, command string"),
        make([("p", "Vite + React"), ("p", "TypeScript")], "project string, framework string"),
        make([("p", "src/utils.ts", 0.35), ("p", "src/types.ts", 0.25)] + [("r", f"f{k:03}", 1.0 - k / 1000) for k in range(200)], "project string, node string, score double"),
        make([("p", "docs", "Documentation"), ("p", "src", "Source code"), ("p", "x", None)], "project string, dir string, purpose string"), ["project"], verbose)


@pytest.fixture(scope="module")
def texts(spark):
    parts = formats.fitting(formats.sections(told(spark), ["project"]), ["project"], 4000)
    return {(r.project, r.format): r.text for r in formats.texts(parts, ["project"]).collect()}


def test_each_format_has_its_sections(texts):
    headers = lambda t: [x for x in t.splitlines() if x.startswith("#")]
    assert headers(texts["p", "claude"]) == ["# CLAUDE.md", "## Quick Reference", "## Commands", "## Critical Constraints", "## Core Modules (by structural importance)", "## Conventions & Patterns", "## Additional Context", "## Before Making Changes", "## What to Add Manually"]
    assert headers(texts["p", "agents"]) == ["# AGENTS.md", "## Commands", "## Constraints", "## Core Modules (by structural importance)", "## Conventions", "## Additional Context", "## What to Add Manually"]
    assert headers(texts["p", "copilot"]) == ["# Copilot Instructions", "## Development Commands", "## Important Constraints", "## Technology Stack", "## High-Impact Files", "## Code Conventions", "## Additional Notes"]
    assert headers(texts["p", "cursor"]) == ["## Commands", "## Constraints", "## Stack", "## Core Modules", "## Conventions", "## Additional Context"] and texts["p", "cursor"].startswith("---\nalwaysApply: true\n---\n")


def test_formats_write_items_in_their_own_way(texts):
    claude, agents, copilot, cursor = (texts["p", f] for f in ("claude", "agents", "copilot", "cursor"))
    assert "- **Dev:** `vite`\n- **Lint:** `eslint`\n- **db:seed:** `seed`" in claude and "pytest" not in claude, "a standard command goes without saying"
    assert "- **Hidden dependencies:** types.ts and utils.ts change together" in claude and "- types.ts and utils.ts change together" in cursor and "unlikely" not in str(texts)
    assert "- **Naming:** short\n- **Style:**\n  - no tabs\n  - tabs" in claude and "- **Style:** tabs" in agents and "- tabs" in copilot
    assert "TypeScript, Vite + React" in copilot and "Vite + React" not in claude and "db:seed" not in cursor and "- db:seed: `seed`" in copilot
    assert "- `src/utils.ts`\n- `src/types.ts`" in cursor and "- **auth:** Auth uses Clerk\n- **routing:** API endpoints use Hono" in claude
    assert "Additional Context" in texts["q", "claude"] and "Before Making" not in texts["q", "claude"] and "Quick" not in texts["q", "claude"] and "start" not in str(texts["q", "agents"])
    assert texts["r", "agents"].count("- `f") == 10 and "f009" in texts["r", "agents"] and "f010" not in texts["r", "agents"]


def test_a_tight_budget_drops_the_least_important(spark, texts):
    parts = formats.fitting(formats.sections(told(spark), ["project"]), ["project"], 60)
    tight = {(r.project, r.format): r.text for r in formats.texts(parts, ["project"]).collect()}
    assert len(tight["p", "claude"]) < len(texts["p", "claude"]) and "Critical Constraints" in tight["p", "claude"] and "Additional Context" not in tight["p", "claude"]
    assert "## Constraints" in tight["p", "agents"] and "## Conventions" not in tight["p", "agents"]
    assert tight["q", "cursor"] == texts["q", "cursor"], "what fits is kept whole"


def test_modes_and_verbose(spark):
    mode = spark.createDataFrame([("p", "library")], "project string, mode string")
    parts = formats.sections(told(spark, True), ["project"], mode, ["claude"], verbose=True)
    got = {r.key: r for r in parts.where("project = 'p'").collect()}
    assert got["core_modules"].priority == 90 and got["structure"].body == "- `docs/`: Documentation" and got["stack"].body == "TypeScript, Vite + React" and "- **Test:** `pytest`" in got["commands"].body
    assert {r.format for r in parts.collect()} == {"claude"} and {r.key: r.priority for r in formats.sections(told(spark), ["project"]).where("project = 'p' AND format = 'claude'").collect()}["core_modules"] == 50


def test_stored_files_keep_what_was_written_by_hand(spark, tmp_path):
    parts = formats.sections(told(spark), ["project"])
    formats.write(formats.texts(parts, ["project"]), f"{tmp_path}/out")
    stored = spark.read.parquet(f"{tmp_path}/out").where("project = 'p'")
    edited = stored.selectExpr("project", "format", "replace(text, '## Commands', '## Mine\n\nkeep me\n\n## Commands') || '\n## Also mine\n\nand me\n' AS text")
    again = {(r.project, r.format): r.text for r in formats.texts(formats.merged(parts, edited, ["project"]), ["project"]).collect()}
    claude = again["p", "claude"]
    assert claude.count("## Mine\n\nkeep me") == 1 and claude.index("## Before Making") < claude.index("## Mine") < claude.index("## Also mine") < claude.index("## What to Add Manually")
    assert again["p", "copilot"].rstrip().endswith("## Also mine\n\nand me") and "Mine" not in again["q", "claude"] and "## Mine" in again["p", "cursor"] and "## Mine" not in again["p", "copilot"]
    plan = spark.read.parquet(f"{tmp_path}/out").where("format = 'cursor'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(format" in plan
    assert formats.texts(formats.sections(told(spark).limit(0), ["project"]), ["project"]).collect() == []
