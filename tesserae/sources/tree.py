"""A repository's working tree as a Python data source: every file, those with a leading dot or underscore too.

Spark's file readers skip such names, follow links and list ignored folders only to drop what they find. Here the driver
lists folders to a small depth, ignored ones pruned before they are entered, and each input partition is a slice of
folders that its task walks and reads on its own. Links are neither followed nor listed. Every executor must see the folder.

    spark.dataSource.register(tree.Tree); spark.read.format("tree").load("/work/repo")

Options: depth (folders planned on the driver, 2), slices (input partitions at most, 64), contents (true), most (bytes of
a file that are read at most; a larger one has null content). A file that can't be read, or whose bytes aren't UTF-8, has its
content replaced or null, and is listed all the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that are never entered, files that are never listed.
PRUNED = {"node_modules", "dist", "build", ".git", ".next", "coverage", ".expo", "android", "ios", ".claude"}
UNLISTED = ("package-lock.json",)
SCHEMA = "path string, size long, content string"
BATCH = 1 << 22  # bytes of contents in one batch


def listed(name: str) -> bool:
    return not name.endswith(".lock") and name not in UNLISTED


def entries(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """The names of the folders in one that may be entered, and its files, both by name; nothing where it can't be read."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for e in sorted(found, key=lambda e: e.name):
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in PRUNED:
                        folders.append(e.name)
                elif e.is_file(follow_symlinks=False) and listed(e.name):
                    files.append(e)
    except OSError:
        pass
    return folders, files


class Slice(InputPartition):
    """Folders, relative to the root: (path, whether what is below belongs to it too)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.root = os.path.abspath(path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path)
        self.depth, self.slices = int(options.get("depth", 2)), int(options.get("slices", 64))
        self.contents, self.most = options.get("contents", "true").lower() == "true", int(options.get("most", 10 << 20))

    def partitions(self) -> list[Slice]:
        """Folders above the depth are read by themselves; each one at the depth with all that is below it."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        plan, level = [], [""]
        for k in range(self.depth + 1):
            plan += [(folder, k == self.depth) for folder in level]
            if k < self.depth:
                level = [os.path.join(folder, name) for folder in level for name in entries(os.path.join(self.root, folder))[0]]
        n = max(1, min(self.slices, len(plan)))
        return [Slice(plan[k::n]) for k in range(n)]

    def walk(self, folder: str, deep: bool) -> Iterator[os.DirEntry]:
        todo = [os.path.join(self.root, folder)]
        while todo:
            at = todo.pop()
            below, files = entries(at)
            yield from files
            if deep:
                todo += [os.path.join(at, name) for name in reversed(below)]

    def text(self, e: os.DirEntry) -> str | None:
        try:
            if not self.contents or e.stat(follow_symlinks=False).st_size > self.most:
                return None
            with open(e.path, "rb") as f:
                return f.read().decode("utf-8", "replace")
        except OSError:
            return None

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str | None]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            path, size, content = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(content, pa.string())], ["path", "size", "content"])

        for folder, deep in partition.folders:
            for e in self.walk(folder, deep):
                try:
                    size = e.stat(follow_symlinks=False).st_size
                except OSError:
                    continue  # gone since it was listed
                name = os.path.relpath(e.path, self.root).replace(os.sep, "/").encode("utf-8", "replace").decode()
                rows.append((name, size, self.text(e)))
                held += len(rows[-1][2] or "") + 200
                if held > BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class Tree(DataSource):
    """format("tree"): (path, size, content) of a folder's files."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def files(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, size, content) of all files below a folder that every executor sees."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").options(**{k: str(v) for k, v in options.items()}).load(root)
