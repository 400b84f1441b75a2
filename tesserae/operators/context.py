"""Signals that tie files to a task or to other files, for companions and context queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import basename, dirname, is_source_for_tasks, is_test_for_tasks, stem
from ..functions.text import ngrams, words
from .graph import fan_in

# Files that pass on what lies beside them.
FACADES = ("__init__.py", "mod.rs", "index.ts", "index.js")
# File names that say too little to be looked for in a text.
GENERIC = ("index", "main", "utils", "types", "config", "constants", "helpers", "test", "mod", "lib", "app")


def _signal(df: DataFrame, stage: int, name: str, points: Column, gated: bool = False) -> DataFrame:
    return df.select("item", "companion", F.lit(stage).alias("stage"), F.lit(name).alias("signal"), points.alias("points"), F.lit(gated).alias("gated"))


def file_signals(primary: DataFrame, partners: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Signals of companions for primary (item). Tests are no companions.

    Co-change, linked siblings, imports, importers; and, only where those are silent, names that extend one another,
    Go and Rust files of the same folder, and what a facade that the file imports passes on from its own folder.
    """
    p = primary.select("item").distinct()
    e = edges.select("src", "dst").distinct()
    plain = lambda c: ~is_test_for_tasks(F.col(c)) & (basename(F.col(c)) != "__init__.py")
    sibling = is_source_for_tasks(F.col("companion")) & ~is_test_for_tasks(F.col("companion"))
    outward = e.select(F.col("src").alias("item"), F.col("dst").alias("companion")).join(p, "item", "left_semi")
    inward = e.select(F.col("dst").alias("item"), F.col("src").alias("companion")).join(p, "item", "left_semi")
    one = _signal(partners.join(p, "item", "left_semi").withColumnRenamed("partner", "companion").where(~is_test_for_tasks(F.col("companion"))), 1, "co-change", F.least(F.col("strength") * 0.8, F.lit(0.6)))
    near = outward.unionByName(inward).distinct().where((dirname(F.col("item")) == dirname(F.col("companion"))) & sibling)
    two = _signal(near, 2, "linked sibling", F.lit(0.4))
    three = _signal(outward.where(plain("companion")), 3, "imports", F.lit(0.25))
    wide = fan_in(edges).where("edges >= 5").select(F.col("node").alias("companion"), F.lit(0.1).alias("more"))
    four = _signal(inward.where(plain("companion")).join(wide, "companion", "left"), 4, "imported by", F.lit(0.2) + F.coalesce("more", F.lit(0.0)))
    five = _signal(prefix_pairs(p, files).where(sibling), 5, "name prefix", F.lit(0.4), gated=True)
    packaged = lambda c: F.lower(c).rlike(r"\.(go|rs)$")
    a, b = p.where(packaged("item")).select("item", dirname(F.col("item")).alias("dir")), files.select(F.col("path").alias("companion"), dirname(F.col("path")).alias("dir"))
    six = _signal(a.join(b, "dir").where(sibling), 6, "same folder", F.lit(0.35), gated=True)
    facade = outward.where(basename(F.col("companion")).isin(*FACADES)).withColumnRenamed("companion", "front")
    passed = e.where(basename(F.col("src")).isin(*FACADES) & (dirname(F.col("src")) == dirname(F.col("dst")))).select(F.col("src").alias("front"), F.col("dst").alias("companion"))
    beside = facade.join(passed, "front").where(~is_test_for_tasks(F.col("companion")))
    seven = _signal(beside.select("item", "companion").distinct(), 7, "facade", F.lit(0.3), gated=True)
    return reduce(DataFrame.unionByName, [one, two, three, four, five, six, seven]).where("item <> companion")


def _named(paths: DataFrame, path: str, name: str) -> DataFrame:
    return paths.select(F.col(path).alias(name), dirname(F.col(path)).alias("dir"), stem(F.col(path)).alias("stem"))


def _prefixes(named: DataFrame, least: int) -> DataFrame:
    """named with a row for each prefix of its stem that ends at a boundary: before `_` or before what is its own capital."""
    s = F.col("stem")
    after = lambda n: F.substr(s, n + 1, F.lit(1))
    ends = F.filter(F.sequence(F.lit(least), F.greatest(F.length(s), F.lit(least))), lambda n: (n <= F.length(s)) & ((after(n) == "_") | (after(n) == F.upper(after(n)))))
    return named.withColumn("stem", F.explode(F.transform(ends, lambda n: F.substr(s, F.lit(1), n))))


def prefix_pairs(primary: DataFrame, files: DataFrame, least: int = 4) -> DataFrame:
    """(item, companion) in one folder whose names extend one another at a word boundary.

    Names are cut into their prefixes, a few each, and meet other names by equality on (folder, name); files of a folder are
    never paired with all others. Both ways round: the item's name is the longer one, or the companion's.
    """
    a, b = _named(primary.distinct(), "item", "item"), _named(files.select("path").distinct(), "path", "companion")
    longer = _prefixes(a, least).join(b, ["dir", "stem"]).select("item", "companion")
    shorter = a.join(_prefixes(b, least), ["dir", "stem"]).select("item", "companion")
    return longer.unionByName(shorter).where("item <> companion").distinct()


def keyword_files(tasks: DataFrame, files: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(task, path, phrase): files whose name holds a phrase of the task's text; three-word phrases come first.

    Phrases are cut from the names as well, so this is an equality join. Neither side is broadcast: Spark takes exploded
    rows for as small as what they are cut from.
    """
    w = words(F.col("text"), stop=stop)
    phrases = tasks.select("task", F.posexplode(F.concat(ngrams(w, 3), ngrams(w, 2))).alias("pos", "phrase"))
    parts = words(F.regexp_replace(F.regexp_replace(stem(F.col("path")), "([a-z])([A-Z])", "$1_$2"), "_", " "), least=1)
    named = files.select("path", F.explode(F.array_distinct(F.concat(ngrams(parts, 3), ngrams(parts, 2)))).alias("phrase"))
    return phrases.hint("merge").join(named, "phrase").groupBy("task", "path").agg(F.min_by("phrase", "pos").alias("phrase"))


def mentioned(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task, path): files that a text names by path, or by a telling base name as a word of its own; no side is broadcast."""
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[\w./@-]*[\w]"), F.lit(0)))).alias("said")
    spoken = tasks.select("task", said)
    name = F.when((F.length(stem(F.col("path"))) >= 4) & ~F.lower(stem(F.col("path"))).isin(*GENERIC), F.array("path", basename(F.col("path")), stem(F.col("path")))).otherwise(F.array("path"))
    return spoken.hint("merge").join(files.select("path", F.explode(F.array_distinct(name)).alias("said")), "said").select("task", "path").distinct()


def test_candidates(modified: DataFrame, files: DataFrame) -> DataFrame:
    """(item, test, pos): the first existing test file of each modified (item), by name templates; changed ones are passed over."""
    d = dirname(F.col("item"))
    e = F.regexp_extract(basename(F.col("item")), r"(\.[^.]+)$", 1)

    def fill(template: str) -> Column:
        out = F.lit(template)
        for key, value in (("{d}", d), ("{s}", stem(F.col("item"))), ("{e}", e)):
            out = F.replace(out, F.lit(key), value)
        return F.regexp_replace(out, r"^\./", "")

    rows = modified.select("item", F.posexplode(F.array(*map(fill, fixed.TEST_TEMPLATES))).alias("pos", "test"))
    known = files.select(F.col("path").alias("test")).join(modified.select(F.col("item").alias("test")), "test", "left_anti")
    rows = rows.join(known, "test", "left_semi")
    return rows.groupBy("item").agg(F.min_by("test", "pos").alias("test"), F.min("pos").alias("pos"))


def file_context(path: str, ranks: DataFrame, hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a file: its rank among all, whether it is a hub, and its distinct neighbours either way."""
    order = ranks.where(F.col("node") == path).select(F.col("score").alias("own"))
    place = ranks.crossJoin(F.broadcast(order)).agg((F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("node") < path))) + 1).alias("rank"), F.count(F.lit(1)).alias("of"))
    hub = hubs.agg(F.coalesce(F.bool_or(F.col("node") == path), F.lit(False)).alias("hub"))
    near = edges.agg(F.array_sort(F.collect_set(F.when(F.col("dst") == path, F.col("src")))).alias("importers"), F.array_sort(F.collect_set(F.when(F.col("src") == path, F.col("dst")))).alias("imports"))
    return place.crossJoin(hub).crossJoin(near)
