"""Repository sources and report sinks on small trees."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import assoc
from tesserae.sinks import report as sink
from tesserae.sources import repository, tree


def test_files_leave_out_ignored_folders(spark, tmp_path):
    for name, body in {"src/a.ts": "x", ".env": "y", "node_modules/m/i.js": "no", "lib/package-lock.json": "{}", "dist/o.js": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert {(r.path, r.size, r.content) for r in repository.files(spark, str(tmp_path)).collect()} == {("src/a.ts", 1, "x")}
    assert repository.files(spark, str(tmp_path), contents=False).columns == ["path", "size"]


def test_commits_feed_association(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(f"COMMIT\t{k}\t{1700000000 + k}\tfix: {k}\n\nM\tsrc/a.ts\nA\tsrc/b.ts\n" + ("R090\told.ts\tsrc/c.ts\n" if k % 2 else "") for k in range(4)))
    rows = repository.commit_files(repository.commits(spark, str(tmp_path / "log.txt")))
    assert rows.count() == 10 and {r.status for r in rows.collect()} == {"M", "A", "R"}
    pairs = assoc.cooccur(rows.where(repository.is_source(F.col("path"))), ["commit_id"], "path")
    assert {tuple(r) for r in pairs.collect()} == {("src/a.ts", "src/b.ts", 4, 1.0), ("src/a.ts", "src/c.ts", 2, 0.5), ("src/b.ts", "src/c.ts", 2, 0.5)}


def test_manifests_hunks_and_runs(spark, tmp_path):
    m = spark.createDataFrame([(0, '{"dependencies":{"a":"1","b":"1"}}'), (1, "broken"), (2, '{"devDependencies":{"a":"2"}}')], "pos int, content string")
    assert {tuple(r) for r in repository.dependencies(m).collect()} == {("a", "2"), ("b", "1")}
    d = spark.createDataFrame([("f", "@@ -1 +1 @@\n+def x():\n+ y = 1\n-def z():")], "path string, diff string")
    assert [r.line for r in repository.hunks(d).orderBy("pos").collect()] == ["@@ -1 +1 @@", "+def x():"]
    for k, body in enumerate(['{"repo":"r","issue_title": ,"timestamp":"2024-05-01T1"}', '{"repo":"s","error":"e","timestamp":"2024-05-01"}', '{"repo":"t","timestamp":"2023-01-01"}']):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "summary.json").write_text(body)
    assert [r.repo for r in repository.runs(spark, str(tmp_path), "repo string, issue_title string", "2024-01-01").collect()] == ["r"]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(1, "B", "two"), (0, "", "one")], "pos int, header string, body string")
    assert sink.render(s) == "one\n\n## B\n\ntwo\n"
    sink.write_inside(str(tmp_path), "x/r.md", "hi")
    with pytest.raises(ValueError):
        sink.write_inside(str(tmp_path), "../r.md", "no")
    sink.json_lines(s, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert (sink.exit_code(s), sink.exit_code(s.limit(0))) == (1, 0)


@pytest.fixture
def work(tmp_path):
    files = {
        "src/a.ts": "x", "src/deep/er/still/b.py": "é", ".github/workflows/ci.yml": "on: push", ".env": "A=1", "_private/x.ts": "u", "src/_base.ts": "", "node_modules/m/i.js": "no", "lib/package-lock.json": "{}",
        "dist/o.js": "", "yarn.lock": "", ".claude/x.md": "", "packages/a/node_modules/z/i.js": "no", "a b/c%20d.ts": "odd", "README.md": "top",
    }
    for name, body in files.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(body)
    (tmp_path / "repo/src/bin.ts").write_bytes(b"\xff\xfea\x00")
    (tmp_path / "outside.ts").write_text("secret")
    (tmp_path / "repo/link.ts").symlink_to(tmp_path / "outside.ts")
    (tmp_path / "repo/loop").symlink_to(tmp_path / "repo")
    return tmp_path / "repo"


WANTED = {"src/a.ts", "src/deep/er/still/b.py", ".github/workflows/ci.yml", ".env", "_private/x.ts", "src/_base.ts", "a b/c%20d.ts", "README.md", "src/bin.ts"}


@pytest.mark.parametrize("options", [{}, {"depth": 0}, {"depth": 9, "slices": 3}, {"depth": 1, "slices": 1}])
def test_the_tree_lists_every_file(spark, work, options):
    got = {r.path: (r.size, r.content) for r in tree.files(spark, str(work), **options).collect()}
    assert set(got) == WANTED and tree.files(spark, f"file://{work}", **options).count() == len(WANTED)
    assert got["src/deep/er/still/b.py"] == (2, "é") and got[".env"] == (3, "A=1") and got["src/bin.ts"][1] == "��a\x00" and got["src/_base.ts"] == (0, "")


def test_the_tree_reads_what_it_may(spark, work):
    assert {r.content for r in tree.files(spark, str(work), contents=False).collect()} == {None}
    assert {r.path for r in tree.files(spark, str(work), most=2).where("content IS NULL").collect()} == {"src/bin.ts", ".github/workflows/ci.yml", ".env", "a b/c%20d.ts", "README.md"}
    (work / "empty").mkdir()
    assert tree.files(spark, str(work / "empty")).collect() == []
    with pytest.raises(Exception, match="FileNotFoundError|nowhere"):
        tree.files(spark, str(work / "nowhere")).collect()


def test_slices_share_the_folders(work):
    reader = tree.TreeReader({"path": str(work), "depth": "2", "slices": "4"})
    slices = reader.partitions()
    folders = [f for s in slices for f, _ in s.folders]
    assert len(slices) == 4 and len(folders) == len(set(folders)) and not any("node_modules" in f or f.startswith((".git/", "dist", "loop")) for f in folders)


def test_a_tree_feeds_a_scan(spark, work):
    from tesserae.operators import rules

    files = tree.files(spark, str(work))
    assert {r.path for r in rules.sample(files, 50, files.selectExpr("path", "1 AS rank").limit(0), files.selectExpr("path", "1 AS rank").limit(0)).collect()} == WANTED
