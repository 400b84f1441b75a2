"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comments(text: Column) -> Column:
    """Without markup, doc-string, block and line comments; line comments start at any two slashes, URLs included."""
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r'(?s)""".*?"""', '""')
    text = F.regexp_replace(text, r"(?s)'''.*?'''", "''")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(text, r"//[^\n]*", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def ascii_safe(text: Column) -> Column:
    """Dashes, quotes and ellipses in ASCII; any other character outside it as a question mark."""
    text = F.translate(text, "–—‘’“”", "--''\"\"")
    text = F.regexp_replace(text, "…", "...")
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def tokens(size: Column) -> Column:
    """The estimated tokens of so many characters."""
    return F.ceil(size / 4).cast("long")


def words(text: Column, least: int = 3, stop: Sequence[str] = ()) -> Column:
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def ngrams(found: Column, n: int) -> Column:
    """Runs of n words joined by underscores."""
    out = found
    for k in range(1, n):
        out = F.zip_with(out, F.slice(found, k + 1, 2_000_000_000), lambda x, y: F.concat(x, F.lit("_"), y))
    return F.slice(out, 1, F.greatest(F.size(found) - n + 1, F.lit(0)))


def preview(text: Column, lines: int = 20) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def commit_scope(subject: Column) -> Column:
    """The scope of a conventional commit subject; null if it isn't one, empty if it names none."""
    pattern = r"^(feat|fix|docs|refactor|test|chore|style|perf|ci|build)(\(([^)]+)\))?!?:"
    return F.when(subject.rlike(pattern), F.regexp_extract(subject, pattern, 3))
