"""A scan kept up to date over restarts and expiry."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tesserae.operators import patterns
from tesserae.streaming import incremental, watch

SCHEMA = "path string, content string, removed boolean, version timestamp"


@pytest.fixture
def tree(spark, tmp_path):
    """Writes versions of files and runs the query over what is new; returns the changes of that run."""
    (tmp_path / "in").mkdir()
    count = [0]

    def run(*versions, seconds=None):
        count[0] += 1
        rows = [{"path": p, "content": c, "removed": c is None, "version": f"2024-01-01T00:00:{count[0]:02d}.{k:03d}Z"} for k, (p, c) in enumerate(versions)]
        (tmp_path / "in" / f"{count[0]}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        out = str(tmp_path / "out")
        before = spark.read.schema(incremental.CHANGES).parquet(out).count() if (tmp_path / "out").exists() else 0
        stream = watch.watched(watch.changes(spark, str(tmp_path / "in"), SCHEMA), ("src/own.ts",))
        query = incremental.keep(spark, stream, out, str(tmp_path / "checkpoint"), seconds)
        query.awaitTermination(180)
        assert query.exception() is None
        table = spark.read.schema(incremental.CHANGES).parquet(out)
        run.table = table
        return table.count() - before, {tuple(r) for r in incremental.newest(table).collect()}

    return run


ZOD = 'import { z } from "./z";\nz.object({})'


def test_only_changes_are_told(spark, tree):
    told, now = tree(("src/a.ts", ZOD), ("src/b.ts", ZOD), ("src/own.ts", ZOD), ("node_modules/x.ts", ZOD), ("lib/p.py", "from .q import r"))
    assert told == 5 and now == {("src/a.ts", "import", "./z"), ("src/a.ts", "pattern", "schema/Zod"), ("src/b.ts", "import", "./z"), ("src/b.ts", "pattern", "schema/Zod"), ("lib/p.py", "import", ".q")}
    assert tree(("src/a.ts", ZOD + "\n// only a comment"), ("src/b.ts", ZOD))[0] == 0, "a restart, and versions that show the same"
    told, now = tree(("src/a.ts", 'import { z } from "./z";\nuseQuery(k)'), ("src/c.ts", "x"))
    assert told == 2 and {v for p, _, v in now if p == "src/a.ts"} == {"./z", "state/React Query/TanStack Query"}
    told, now = tree(("src/b.ts", None), ("src/never.ts", None))
    assert told == 2 and not any(p == "src/b.ts" for p, *_ in now)
    assert tree(("src/b.ts", ZOD), ("src/b.ts", "x"), ("src/b.ts", 'require("./y")'))[0] == 1, "of versions in one batch the newest counts"
    assert {tuple(r) for r in incremental.votes(incremental.newest(tree.table)).collect()} == {("state", "React Query/TanStack Query", 1)}


def test_forgotten_paths_are_told_in_full(spark, tree):
    first, now = tree(("src/a.ts", ZOD), seconds=2)
    assert first == 2
    time.sleep(3)
    again, same = tree(("src/a.ts", ZOD), seconds=2)
    assert again == 2 and same == now, "told twice, counted once"


def test_facts_are_those_of_a_whole_scan(spark):
    texts = [ZOD, "router.get('/a'); jwt.verify(t) // prisma.user", "describe('x', () => it('y'))", "from fastapi import FastAPI", None, ""]
    rows = [(f"{d}/f{k}.{x}", t) for k, t in enumerate(texts) for d, x in (("src", "ts"), ("lib", "py"), ("docs", "ts"), ("src", "test.ts"))]
    files = spark.createDataFrame(rows, "path string, content string")
    each = incremental.facts(files).select("path", F.explode("facts").alias("f"))
    now = each.select("path", F.split_part("f", F.lit("\x1f"), F.lit(1)).alias("kind"), F.split_part("f", F.lit("\x1f"), F.lit(2)).alias("value"))
    assert {tuple(r) for r in incremental.votes(now).collect()} == {tuple(r) for r in patterns.tally(files).collect()}
