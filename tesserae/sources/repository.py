"""Repositories as tables: files, commits, changed files, diffs and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that a listing leaves out.
IGNORED = r"(^|/)(node_modules|dist|build|\.git|\.next|coverage|\.expo|android|ios|\.claude)(/|$)|\.lock$|(^|/)package-lock\.json$"
SOURCE = r"\.(ts|tsx|js|jsx|py|go|rs)$"
#: git log --name-status --format='COMMIT%x09%H%x09%at%x09%s'
RECORD = "COMMIT\t"


def files(spark: SparkSession, root: str, contents: bool = True) -> DataFrame:
    """(path, size, content) of the files under root, relative to it; unreadable text is replaced.

    Spark's readers skip names that start with a dot or an underscore; export such files under other names.
    Content is decoded only where it is asked for: without it, the reader doesn't open the files.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    same = F.regexp_replace("path", "^file:/+", "file:/")
    path = F.substring(same, len(full.replace("file:///", "file:/")) + 1, 1_000_000)
    rows = df.select(path.alias("path"), F.col("length").alias("size"), *([F.decode("content", "UTF-8").alias("content")] if contents else []))
    return rows.where(~F.col("path").rlike(IGNORED))


def commits(spark: SparkSession, export: str) -> DataFrame:
    """(commit_id, ts, subject, lines) of a git log export; lines hold its name-status rows."""
    block = F.split("value", "\n")
    head = F.split(block[0], "\t", 3)
    rows = spark.read.option("lineSep", RECORD).text(export).where("trim(value) <> ''")
    return rows.select(head[0].alias("commit_id"), F.timestamp_seconds(head[1].cast("long")).alias("ts"), head[2].alias("subject"), F.filter(F.slice(block, 2, 1_000_000), lambda x: x.contains("\t")).alias("lines"))


def commit_files(log: DataFrame) -> DataFrame:
    """(commit_id, ts, subject, status, path), one row a changed file; a rename counts under its new name."""
    rows = log.select("commit_id", "ts", "subject", F.explode_outer("lines").alias("line")).where("line IS NOT NULL")
    parts = F.split("line", "\t")
    return rows.select("commit_id", "ts", "subject", F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE) & ~path.rlike(r"(^|/)node_modules/")


def dependencies(manifests: DataFrame) -> DataFrame:
    """(name, version) over package manifests (pos, content); the last manifest wins, malformed ones count as empty."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = manifests.select("pos", F.from_json("content", schema).alias("m"))
    parts = parsed.select("pos", F.explode_outer(F.array(F.struct(F.lit(0).alias("k"), F.col("m.dependencies").alias("d")), F.struct(F.lit(1).alias("k"), F.col("m.devDependencies").alias("d")))).alias("p"))
    rows = parts.select("pos", "p.k", F.explode("p.d").alias("name", "version"))
    return rows.groupBy("name").agg(F.max_by("version", F.struct("pos", "k")).alias("version"))


def hunks(diffs: DataFrame, most: int = 20) -> DataFrame:
    """(path, pos, line): the hunk headers and added declarations of diffs (path, diff), the first so many of each."""
    from pyspark.sql import Window

    rows = diffs.select("path", F.posexplode(F.split("diff", "\n")).alias("pos", "line"))
    declared = F.col("line").rlike(r"^\+\s*(export|function|class|def|func|fn|pub|const|interface|type|struct)\b") & (F.length("line") <= 120)
    rows = rows.where(F.col("line").startswith("@@") | declared)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def runs(spark: SparkSession, folder: str, schema: str, since: str | None = None) -> DataFrame:
    """Run records, one JSON file each; titles left empty are repaired, records with an error skipped."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").text(folder)
    fixed = F.regexp_replace("value", r'("issue_title":\s*),', r'$1"",')
    rows = raw.select(F.from_json(fixed, schema + ", error string, timestamp string").alias("r")).select("r.*").where("error IS NULL")
    return rows if since is None else rows.where(F.substring("timestamp", 1, 10) >= since)


def listing(files: DataFrame, most: int = 25) -> DataFrame:
    """(dir, entry): what stands in each top-level folder of files (path), folders with a slash, the first 25 of each by name."""
    from pyspark.sql import Window

    parts = F.split("path", "/")
    entry = F.when(F.size(parts) > 2, F.concat(parts[1], F.lit("/"))).otherwise(F.get(parts, F.lit(1)))
    rows = files.where(F.contains("path", F.lit("/"))).select(parts[0].alias("dir"), entry.alias("entry")).distinct()
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("entry"))).where(F.col("r") <= most).drop("r")


def folder_tree(files: DataFrame, folders: DataFrame, most: int = 25, total: int = 35) -> DataFrame:
    """(dir, pos, line): what stands in each of folders (dir) and one level below, as an indented list of so many lines at most.

    Of each level the first entries by name count, hidden and built ones among them, though these aren't shown.
    """
    from pyspark.sql import Window

    parts = F.split("path", "/")
    # A file lies below each of its folders: these meet the asked ones by equality.
    at = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), F.slice(parts, n + 1, F.lit(3)).alias("rest"))))
    rows = files.where(F.contains("path", F.lit("/"))).select(at.alias("v")).select("v.*").join(folders.select("dir").distinct(), "dir", "left_semi")
    name = lambda k: F.when(F.size("rest") > k + 1, F.concat(F.get("rest", F.lit(k)), F.lit("/"))).otherwise(F.get("rest", F.lit(k)))
    rows = rows.select("dir", name(0).alias("one"), name(1).alias("two"))
    shown = lambda c: ~F.col(c).startswith(".") & ~F.regexp_replace(c, "/$", "").isin("node_modules", "dist", "__pycache__")
    first = rows.select("dir", "one").distinct().withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("one"))).where((F.col("r") <= most) & shown("one")).drop("r")
    below = rows.where("two IS NOT NULL").select("dir", "one", "two").distinct().join(first, ["dir", "one"], "left_semi")
    below = below.withColumn("r", F.row_number().over(Window.partitionBy("dir", "one").orderBy("two"))).where((F.col("r") <= most) & shown("two")).drop("r")
    lines = first.select("dir", "one", F.lit("").alias("two"), F.col("one").alias("line")).unionByName(below.select("dir", "one", "two", F.concat(F.lit("  "), "two").alias("line")))
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy("dir").orderBy("one", "two"))).where(F.col("pos") <= total).select("dir", "pos", "line")


def inside(paths: DataFrame, root: str) -> DataFrame:
    """The rows of paths (path) that stay below a folder once their dots are resolved; others can't be read."""
    kept = F.aggregate(F.split("path", "/"), F.lit(0), lambda depth, p: F.when(depth < 0, -1).when(p == "..", depth - 1).when((p == "") | (p == "."), depth).otherwise(depth + 1))
    below = ~F.col("path").startswith("/") | F.col("path").startswith(root.rstrip("/") + "/")
    return paths.where(below & (kept >= 0) & (~F.contains("path", F.lit("..")) | ~F.col("path").startswith("/")))
