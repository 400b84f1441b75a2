"""Imports and links out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = (
    r"""(?m)(?:import|export)[^\n]*?from\s+['"]([^'"\n]+)['"]""",
    r"""import\(\s*['"]([^'"\n]+)['"]\s*\)""",
    r"""require\(\s*['"]([^'"\n]+)['"]\s*\)""",
)


def found(text: Column, *patterns: str) -> Column:
    """All first groups, pattern by pattern, duplicates kept."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))


def script_imports(text: Column) -> Column:
    """Relative and aliased module names in JavaScript or TypeScript, block comments left out."""
    names = found(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), *SCRIPT)
    return F.filter(names, lambda n: n.startswith(".") | n.startswith("@/") | n.startswith("~/"))


def python_imports(text: Column) -> Column:
    return found(text, r"(?m)^\s*from\s+(\.*[\w.]*)\s+import\b", r"(?m)^\s*import\s+([\w.]+)")


def go_imports(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)import\s*\((.*?)\)"), F.lit(1))
    grouped = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"\n]+)"'), F.lit(1))))
    return F.concat(grouped, F.regexp_extract_all(text, F.lit(r'(?m)^import\s+(?:\w+\s+)?"([^"\n]+)"'), F.lit(1)))


def rust_imports(text: Column) -> Column:
    mods = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), F.lit(1)), lambda m: F.concat(F.lit("mod::"), m))
    return F.concat(F.regexp_extract_all(text, F.lit(r"\buse\s+((?:crate|super)(?:::\w+)+)"), F.lit(1)), mods)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(src, dst) of each href, duplicates kept."""
    return pages.select(F.col(key).alias("src"), F.explode_outer(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).where("dst IS NOT NULL")


def normalise(path: Column) -> Column:
    """Without . parts and with .. parts resolved; what climbs over the root keeps its .. parts off."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")
