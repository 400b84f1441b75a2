"""Path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The part before the last slash; "." for a path without one."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def top_dir(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def extension(path: Column) -> Column:
    """The last dot and what follows in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def shorten(path: Column) -> Column:
    """First and last part of a path of more than two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat(parts[0], F.lit("/…/"), F.element_at(parts, -1))).otherwise(path)


def is_test(path: Column) -> Column:
    """Test files as the dependency graph sees them; folders in any case. Go's tests aren't among them."""
    return path.rlike(
        r"(?i:(^|/)(tests?|__tests__|e2e|playwright|cypress)/)|\.(test|spec|test-d)\.[^.]+$|(^|/)tests?\.[^.]+$|(^|/)test_[^/]+\.py$|[^/]+_test\.py$"
    )


def is_test_for_tasks(path: Column) -> Column:
    """Test files as companion ranking sees them: spec folders and Go and Rust tests too."""
    return path.rlike(r"(?i:(^|/)(tests?|__tests__|e2e|spec)/)|[._](test|spec)\.[^.]+$|(^|/)test_[^/]+\.py$|[^/]+_test\.(py|go|rs)$")


def is_example(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(examples?|demos?|samples?)/|(^|/)example[^/]*\.[^.]+$")


def is_entry_point(path: Column) -> Column:
    """Files that are run or read by name, so that nobody has to import them."""
    return path.rlike(r"(?i:(^|/)(pages|app|apps|scripts|migrations|e2e|playwright|cypress)/)|\.(config|setup|workspace)\.[^.]+$")


def is_production(path: Column) -> Column:
    return ~is_test(path) & ~is_example(path)


def is_source_for_pairs(path: Column) -> Column:
    """The files whose changes are paired."""
    return path.rlike(r"\.(ts|tsx|js|jsx|py|go|rs)$") & ~path.contains("node_modules")


def is_source_for_tasks(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(ts|tsx|js|jsx|py|go|rs|rb|java|swift|kt)$")


DOCS, EXAMPLES, BENCHMARKS = r"(?i)(^|/)docs?([_-][^/]+)?/", r"(?i)(^|/)examples?([_-][^/]+)?/", r"(?i)(^|/)benchmarks?/"


def is_program(path: Column) -> Column:
    """The files that may be read for conventions: six extensions, no declarations, nothing below docs."""
    return path.rlike(r"\.(ts|tsx|js|jsx|py|go)$") & ~path.endswith(".d.ts") & ~path.rlike(r"(?i)(^|/)docs?/")


def is_sampled(path: Column) -> Column:
    """The files that samples are drawn from, whatever their extension: no declarations, documentation, examples or benchmarks."""
    return ~path.endswith(".d.ts") & ~path.rlike(DOCS) & ~path.rlike(EXAMPLES) & ~path.rlike(BENCHMARKS)


def is_voted(path: Column) -> Column:
    """The files that vote on dominant patterns: programs without documentation, examples and tests of any kind."""
    named = path.contains(".test.") | path.contains(".spec.") | path.rlike(r"(?i)(^|/)tests?/") | path.rlike(r"(^|/)test_[^/]+\.py$|[^/]_test\.py$")
    return is_program(path) & ~path.rlike(DOCS) & ~path.rlike(EXAMPLES) & ~path.contains("node_modules") & ~named


def is_read_for_tests(path: Column) -> Column:
    """The files that vote on how tests are written: those named so, and voting files whose path speaks of tests."""
    named = path.contains(".test.") | path.contains(".spec.") | path.contains("_test.go") | path.contains("test_")
    return (path.contains("test") | path.contains("spec")) & (named | is_voted(path))


def language(path: Column) -> Column:
    """The language of a source file by extension; null for others."""
    # Extensions and names.
    names = {
        ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".py": "Python", ".go": "Go", ".rs": "Rust",
        ".rb": "Ruby", ".java": "Java", ".swift": "Swift", ".kt": "Kotlin", ".css": "CSS", ".scss": "SCSS", ".html": "HTML",
    }
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.element_at(table, extension(path))
