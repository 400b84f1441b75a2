"""Import specifiers resolved to files: ordered candidates as rows, one equality join, the first hit wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname
from .extract import normalise


def parts_of(path: Column) -> Column:
    """The folders of a path, none for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))


def up(parts: Column, n: Column) -> Column:
    """The parts without the last n, none if there are fewer."""
    return F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0)))


def under(parts: Column, *names: Column) -> Column:
    return F.array_join(F.concat(parts, F.array(*names)), "/")


def first_existing(edges: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """(src, spec, dst): the first of an array of candidates that is a path of files, for distinct edges (src, spec)."""
    rows = edges.select("src", "spec").distinct().select("src", "spec", F.posexplode_outer(candidates).alias("pos", "path")).where("path IS NOT NULL")
    hits = rows.join(files.select("path").distinct(), "path")
    return hits.groupBy("src", "spec").agg(F.min_by("path", "pos").alias("dst"))


def script(edges: DataFrame, files: DataFrame) -> DataFrame:
    """JavaScript and TypeScript: @/ and ~/ start at src/, others at the importer; an ending .js may stand for .ts."""
    spec = F.col("spec")
    aliased = F.concat(F.lit("src/"), F.substring(spec, 3, 1_000_000))
    full = normalise(F.when(spec.rlike("^[@~]/"), aliased).otherwise(F.concat_ws("/", dirname(F.col("src")), spec)))
    bare = F.regexp_replace(full, r"\.js$", "")
    names = [full, bare, *(F.concat(bare, F.lit(x)) for x in (".ts", ".tsx")), *(F.concat(full, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx"))]
    names += [F.concat(bare, F.lit(x)) for x in ("/index.ts", "/index.tsx")] + [F.concat(full, F.lit(x)) for x in ("/index.ts", "/index.tsx", "/index.js", "/index.jsx")]
    return first_existing(edges, F.array(*names), files)


def python(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Python: each dot after the first climbs a folder; modules are looked for at the root, in lib/ and in src/."""
    spec = F.col("spec")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_replace(spec, r"^\.+", "")
    base = F.when(dots > 0, up(parts_of(F.col("src")), dots - 1)).otherwise(F.array().cast("array<string>"))
    module = under(base, F.replace(rest, F.lit("."), F.lit("/")))
    names = [F.concat(F.lit(p), module, F.lit(x)) for p in ("", "lib/", "src/") for x in (".py", "/__init__.py")]
    return first_existing(edges, F.when(rest == "", F.array(under(base, F.lit("__init__.py")))).otherwise(F.array(*names)), files)


def go_modules(files: DataFrame) -> DataFrame:
    """(module, root): the modules that files (path, content) named go.mod declare, and their folders, "" at the top."""
    rows = files.where(basename(F.col("path")) == "go.mod").select(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"), F.array_join(parts_of(F.col("path")), "/").alias("root"))
    return rows.where("module <> ''").groupBy("module").agg(F.min("root").alias("root"))


def go(edges: DataFrame, files: DataFrame, modules: DataFrame | str) -> DataFrame:
    """Go: a package is a folder of a module; its file of the folder's own name stands for it, else the first by name.

    modules (module, root), or the name of one at the top. A specifier belongs to the module with the longest name that begins it
    at a slash: it is cut into its beginnings, these meet modules by equality, and the longest wins.
    """
    if isinstance(modules, str):
        modules = edges.sparkSession.createDataFrame([(modules, "")], "module string, root string")
    packages = files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select("path", F.array_join(parts_of(F.col("path")), "/").alias("dir"))
    named = basename(F.col("path")) != F.concat(basename(F.col("dir")), F.lit(".go"))
    best = packages.groupBy("dir").agg(F.min(F.struct(named, "path")).alias("r")).select("dir", F.col("r.path").alias("dst"))
    parts = F.split("spec", "/")
    begun = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("module"), F.slice(parts, n + 1, F.size(parts)).alias("rest")))).alias("b")
    rows = edges.select("src", "spec").distinct()
    specs = rows.select("spec").distinct().select("spec", begun).select("spec", "b.*").join(modules, "module")
    owned = specs.groupBy("spec").agg(F.max_by(F.struct("root", "rest"), "n").alias("o"))
    dirs = owned.select("spec", F.array_join(F.concat(F.filter(F.array("o.root"), lambda r: r != ""), "o.rest"), "/").alias("dir"))
    return rows.join(dirs.join(best, "dir"), "spec").select("src", "spec", "dst")


def rust(edges: DataFrame, files: DataFrame, depth: int = 10) -> DataFrame:
    """Rust: mod names a sibling, super the folder above, crate what is under the nearest root that holds lib.rs or main.rs."""
    own, spec = parts_of(F.col("src")), F.col("spec")
    either = lambda base, name: [under(base, F.concat(name, F.lit(".rs"))), under(base, name, F.lit("mod.rs"))]
    mods = first_existing(edges.where(spec.startswith("mod::")), F.array(*either(own, F.substring(spec, 6, 1_000_000))), files)
    hops = F.regexp_count(F.regexp_extract(spec, r"^((?:super(?:::|$))+)", 1), F.lit("super"))
    after = F.get(F.split(spec, "::"), hops)
    above = first_existing(edges.where(spec.startswith("super::")), F.when(after.isNotNull(), F.array(*either(up(own, hops), after))), files)
    inside = edges.where(spec.startswith("crate::"))
    ancestors = [up(own, F.lit(k)) for k in range(depth)]
    marks = [under(a, *map(F.lit, m)) for a in ancestors for m in (("lib.rs",), ("main.rs",), ("src", "lib.rs"))]
    roots = first_existing(inside.select("src", F.lit("").alias("spec")), F.array(*marks), files).select("src", parts_of(F.col("dst")).alias("root"))
    path = F.split(F.regexp_replace(spec, "^crate::", ""), "::")
    names = F.array(*(x for k in range(3) for x in either(F.concat(F.col("root"), F.slice(path, 1, k)), F.get(path, F.lit(k)))))
    rows = inside.select("src", "spec").distinct().join(roots, "src").select("src", "spec", F.posexplode(names).alias("pos", "path")).where("path IS NOT NULL")
    below = rows.join(files.select("path").distinct(), "path").groupBy("src", "spec").agg(F.min_by("path", "pos").alias("dst"))
    return reduce(DataFrame.unionByName, [mods, above, below])
