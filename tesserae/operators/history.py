"""What a repository's history tells: reverts, abandoned files, commit conventions, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import dirname, is_source_for_pairs, top_dir
from ..functions.text import commit_scope
from . import assoc, timewin


def reverted(subject: Column) -> Column:
    """What a revert took back; null if a subject isn't a revert."""
    what = F.regexp_extract(subject, r'^Revert "(.+)"', 1)
    return F.when(what != "", what)


def reverts(commits: DataFrame, days: int = 365, most: int = 50, seen: int = 10) -> DataFrame:
    """(total, named): how many of the newest reverts there are, and what of the ten newest isn't noise, newest first.

    commits (commit_id, ts, subject). No row where there are fewer than two.
    """
    newest = timewin.recent(commits, "ts", days).where(F.col("subject").startswith("Revert")).orderBy(F.desc("ts"), "commit_id").limit(most)
    rows = newest.select("ts", "commit_id", reverted(F.col("subject")).alias("what"))
    last = rows.orderBy(F.desc("ts"), "commit_id").limit(seen).where(F.col("what").isNotNull() & ~F.col("what").rlike(fixed.REVERT_NOISE))
    named = last.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("o"), "commit_id", "what"))), lambda r: r["what"]).alias("named"))
    return rows.agg(F.count(F.lit(1)).alias("total")).where("total >= 2").crossJoin(F.broadcast(named))  # one row each


def deleted_batches(commit_files: DataFrame, days: int = 183, least: int = 3, k: int = 3) -> DataFrame:
    """(label, n) of the newest commits that deleted three files or more and aren't noise, and how many others there are."""
    gone = timewin.recent(commit_files, "ts", days).where(F.col("status") == "D").where(~F.col("subject").rlike(fixed.DELETION_NOISE))
    return timewin.batches(gone, "commit_id", "ts", least, k)


def anti_patterns(commits: DataFrame, commit_files: DataFrame, days: int = 365, most: int = 20, told: int = 2) -> DataFrame:
    """(kind, label, n, confidence): what was tried and taken back, the two newest by name and the others by number, then deletions.

    Reverts are the newest twenty of a year, without noise; deletions are those of deleted_batches().
    """
    newest = timewin.recent(commits, "ts", days).where(F.col("subject").startswith("Revert")).orderBy(F.desc("ts"), "commit_id").limit(most)
    rows = newest.select("ts", "commit_id", reverted(F.col("subject")).alias("label")).where(F.col("label").isNotNull() & ~F.col("label").rlike(fixed.REVERT_NOISE))
    rows = rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("ts"), "commit_id")))  # twenty at most
    named = rows.where(F.col("r") <= told).select(F.lit("reverted").alias("kind"), "label", F.lit(1).cast("long").alias("n"), F.lit("high").alias("confidence"))
    rest = rows.agg((F.count(F.lit(1)) - told).alias("n")).where("n > 0").select(F.lit("reverted").alias("kind"), F.lit("others").alias("label"), "n", F.lit("medium").alias("confidence"))
    gone = deleted_batches(commit_files).select(F.lit("deleted").alias("kind"), "label", F.col("n").cast("long").alias("n"), F.lit("medium").alias("confidence"))
    return named.unionByName(rest).unionByName(gone)


def conventions(commits: DataFrame, k: int = 5) -> DataFrame:
    """(scope, n, share): the foremost scopes of conventional subjects, where these are over half of all."""
    rows = commits.select(commit_scope(F.col("subject")).alias("scope"))
    share = timewin.share(rows, F.col("scope").isNotNull()).where("share > 0.5").select("share")
    top = timewin.top_counts(rows.where("scope <> ''"), "scope", k)
    return top.crossJoin(F.broadcast(share))  # at most one row


def enough(commits: DataFrame, shallow: bool, least: int = 50) -> bool:
    """Whether there is history to mine: not of a shallow copy with fewer than fifty commits. Counts no further than that."""
    return not shallow or commits.limit(least).count() >= least


def rapid(commit_files: DataFrame, days: int = 92, commits: int = 300, parts: list[str] | None = None) -> DataFrame:
    """(path, start, n): source files edited five times within a week, of the newest commits; documents and configuration don't count."""
    rows = timewin.newest(timewin.recent(commit_files, "ts", days), commits, parts=parts)
    return timewin.rapid_edits(rows.where(~F.col("path").rlike(fixed.CHURN_NOISE) & ~F.col("path").contains("node_modules")), "path", "ts")


def churn(commit_files: DataFrame, days: int = 92, commits: int = 500, k: int = 20, parts: list[str] | None = None) -> DataFrame:
    """(path, n) of the files that the newest commits changed most, deletions apart."""
    rows = timewin.newest(timewin.recent(commit_files, "ts", days), commits, parts=parts)
    return timewin.top_counts(rows.where(F.col("status").isin("A", "M", "R", "C") & ~F.col("path").contains("node_modules")), "path", k)


def pairs(commit_files: DataFrame, days: int = 183, commits: int = 200, parts: list[str] | None = None, **how) -> DataFrame:
    """(a, b, cnt, strength) of source files that the newest commits changed together."""
    rows = timewin.newest(timewin.recent(commit_files, "ts", days), commits, parts=parts)
    return assoc.cooccur(rows.where(is_source_for_pairs(F.col("path"))), ["commit_id"], "path", **how)


def coupling(commit_files: DataFrame, edges: DataFrame | None = None, days: int = 183, commits: int = 200, k: int = 5, parts: list[str] | None = None) -> DataFrame:
    """The strongest pairs of files of unlike folders that change together, three times or more; pairs that import each other are no secret."""
    found = pairs(commit_files, days, commits, parts, min_count=3, min_strength=0.3, group=dirname(F.col("item")))
    if edges is not None:
        known = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        found = found.join(known, ["a", "b"], "left_anti")
    return found.orderBy(F.desc("strength"), "a", "b").limit(k)


def areas(commit_files: DataFrame, days: int = 30, k: int = 5) -> DataFrame:
    """(dir, n) of the top-level folders with the most recent changes; files at the root have none."""
    rows = timewin.recent(commit_files, "ts", days).where(F.col("status").isin("A", "M", "R", "C") & F.col("path").contains("/") & ~F.col("path").contains("node_modules"))
    return timewin.top_counts(rows.select(top_dir(F.col("path")).alias("dir")), "dir", k)


def modified(changed: DataFrame, extensions: str = r"\.(ts|tsx|js|jsx|py|go|rs|rb|java|swift|kt)$") -> DataFrame:
    """(item, idx) of changed source files (path, idx), each once, by where it is first named: a branch's, or staged and unstaged."""
    return changed.where(F.lower("path").rlike(extensions)).groupBy(F.col("path").alias("item")).agg(F.min("idx").alias("idx"))
