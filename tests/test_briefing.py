"""Briefings within a budget, and standing questions."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import briefing, retrieve
from tesserae.sinks import report as sink


def inputs(spark):
    f = spark.createDataFrame([("Circular dependencies", "a and b", "high"), ("Style", "plain", "high"), ("Misc", "maybe", "medium"), ("Misc", "unlikely", "low")], "category string, description string, confidence string")
    c = spark.createDataFrame([("test", "run it"), ("build", "make")], "name string, command string")
    r = spark.createDataFrame([(f"f{k}", float(k)) for k in range(7)], "node string, score double")
    s = spark.createDataFrame([("React", "18")], "framework string, version string")
    return f, c, r, s


def test_sections_come_in_the_order_of_the_format(spark):
    got = briefing.briefing(*inputs(spark), style="copilot").collect()
    assert [x.key for x in got] == ["stack", "commands", "conventions", "critical", "core_modules", "supplementary"]
    body = {x.key: x.body for x in got}
    assert body["commands"] == "- build: make\n- test: run it" and body["core_modules"] == "- f6\n- f5\n- f4\n- f3\n- f2" and "unlikely" not in str(body)


def test_the_budget_spares_what_is_critical(spark):
    got = briefing.briefing(*inputs(spark), limit=1)
    assert [x.key for x in got.collect()] == ["commands", "critical"]
    assert sink.render(got).startswith("## Commands\n\n- build: make")


def test_nothing_gives_nothing(spark):
    empty = [x.limit(0) for x in inputs(spark)]
    assert briefing.briefing(*empty).collect() == []


def test_pressing_questions(spark):
    one = spark.createDataFrame([(2, "a>b"), (3, "a>b>c")], "length int, path string")
    hubs = spark.createDataFrame([("h", 9), ("g", 9)], "node string, edges int")
    none = spark.createDataFrame([], "node string, n int")
    pairs = spark.createDataFrame([("a", "b", 0.4), ("c", "d", 0.6)], "a string, b string, strength double")
    got = briefing.pressing(one, hubs, none, pairs, spark.createDataFrame([("o",)], "node string")).collect()
    assert [(r.priority, r.n, r.example) for r in got] == [(1, 2, "a>b"), (2, 2, "g"), (4, 2, "c + d"), (5, 1, "o")]
    assert [r[0] for r in pairs.orderBy("strength").select(briefing.strength_label(pairs.strength)).collect()] == ["moderate", "high"]


@pytest.mark.parametrize("query", ["needle", "NEEDLE in", "é日本x", "a.b(c", "zzzz", "ab", "", "a\nb", "abcabd", "100%_x"])
def test_an_index_finds_what_a_scan_finds(spark, tmp_path, query):
    texts = ["a Needle in hay", "needl e", "needle", "xé日本X", "a.b(c)", "aab", None, "", "A\nB", "abcXbcabd bcabca", "abcabd", "100%_X 100", "needle " * 5000]
    df = spark.createDataFrame([(k, t, "needle" if k == 6 else "s") for k, t in enumerate(texts)], "id int, text string, source string")
    retrieve.build(df, "id", ["text", "source"], f"{tmp_path}/i", parts=8)
    got = retrieve.search(df, "id", query, ["text", "source"], f"{tmp_path}/i", parts=8)
    assert sorted(r.id for r in got.collect()) == [k for k, t in enumerate(texts) if query.lower() in (t or "\x00").lower() or query.lower() in ("needle" if k == 6 else "s")]


def test_a_search_reads_the_partitions_of_its_pieces(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "md5(cast(id as string)) AS text")
    retrieve.build(df, "id", ["text"], f"{tmp_path}/i")
    key = df.select(F.col("id").alias("key"))
    plan = retrieve.candidates(key, "3a7f", f"{tmp_path}/i")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(gram" in plan
    sizes = {p.parent.name: p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet")}
    read = sum(sizes[f"part={k}"] for k in {r[0] for r in spark.createDataFrame([(g,) for g in retrieve.pieces("3a7f")], "g string").select(retrieve.part(F.col("g"), retrieve.PARTS)).collect()})
    assert 0 < read < sum(sizes.values()) / 10
    assert retrieve.search(df, "id", "3a7f", ["text"], f"{tmp_path}/i").count() == df.where("contains(text, '3a7f')").count()


def test_search_tells_folders_frameworks_and_the_total(spark):
    f = spark.createDataFrame([("Routing", "by files"), ("Style", "tabs")], "category string, description string")
    d = spark.createDataFrame([("routes", "Routes"), ("x", "Routing table"), ("routed", None)], "dir string, purpose string")
    w = spark.createDataFrame([("Expo Router",), ("React",)], "framework string")
    got = {tuple(r) for r in retrieve.everywhere("ROUT", f, d, w).collect()}
    assert got == {("finding", "Routing", "by files", 4), ("folder", "routes", "Routes", 4), ("folder", "x", "Routing table", 4), ("framework", "Expo Router", None, 4)}
