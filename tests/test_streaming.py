"""Streams over files and rate limits, run to the end of what is there."""

import datetime
import json

from tesserae.streaming import watch


def write(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_bursts_close_after_the_gap(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    write(tmp_path, "1.json", [{"key": "a", "ts": at(0)}, {"key": "a", "ts": at(1)}, {"key": "a", "ts": at(10)}, {"key": "b", "ts": at(3)}])
    write(tmp_path, "2.json", [{"key": "c", "ts": at(50)}])
    got = run(watch.bursts(watch.changes(spark, str(tmp_path), "key string, ts timestamp"), "ts", "key"), spark, "bursts")
    assert {(r.key, r.start.second, r.n) for r in got.collect()} == {("a", 0, 2), ("a", 10, 1), ("b", 3, 1)}


def test_unchanged_batches_are_not_passed_on(spark):
    seen = []
    each = watch.when_changed(lambda df, n: seen.append(n), "x")
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    for n, batch in enumerate([df, df.repartition(2), df.limit(1), df.limit(1), df]):
        each(batch, n)
    assert seen == [0, 2, 4]


def test_rate_limit_opens_at_the_first_request(spark, tmp_path):
    at = lambda s: (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)).isoformat() + "Z"
    write(tmp_path, "1.json", [{"key": "a", "ts": at(s)} for s in (30, 31, 32, 89, 90)] + [{"key": "b", "ts": at(5)}])
    stream = watch.rate_limit(watch.changes(spark, str(tmp_path), "key string, ts timestamp"), "key", "ts", 60, 3)
    got = run(stream, spark, "limited")
    rows = {(r.key, int(r.ts.timestamp()) % 3600): r.allowed for r in got.collect()}
    assert list(dict(sorted(rows.items())).values()) == [True, True, True, False, True, True]


def test_memory_outlives_a_restart(spark, tmp_path):
    a, b, out = spark.createDataFrame([("x",), ("y",)], "line string"), spark.createDataFrame([("z",)], "line string"), []
    for batch in (a, a, b, b.union(a), a.union(b)):
        watch.when_changed(lambda df, n: out.append(df.count()), "line", f"{tmp_path}/seen")(batch, 0)
    assert out == [2, 1, 3]


def test_cache_and_filters(spark):
    now, built = [0.0], []
    cache = watch.Cache(300, lambda: now[0])

    def build():
        built.append(1)
        return spark.range(3)

    for at, refresh in ((0, False), (299, False), (300, False), (301, True)):
        now[0] = at
        assert cache.get("dir", build, refresh).count() == 3
    assert len(built) == 3
    paths = spark.createDataFrame([("src/a.ts",), ("AGENTS.md",), ("dist/b.js",), ("src/own.ts",)], "path string")
    assert [r.path for r in watch.watched(paths, ("src/own.ts",)).collect()] == ["src/a.ts"]
