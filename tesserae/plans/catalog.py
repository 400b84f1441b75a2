"""Every registered query of the core engine with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import assoc, changes, context, extract, graph, report, resolve, rules, timewin, vote
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_sql(source: str, min_count: int, min_strength: float, extra: str = "") -> str:
    """Jaccard pairs of source(txn, item)."""
    return f"""
WITH base AS (SELECT DISTINCT txn, item FROM ({source}) WHERE txn IS NOT NULL AND item IS NOT NULL),
kept AS (SELECT * FROM base WHERE txn IN (SELECT txn FROM base GROUP BY txn HAVING count(*) BETWEEN 2 AND 20)),
m AS (SELECT item, count(*) AS n FROM kept GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS cnt FROM kept x JOIN kept y ON x.txn = y.txn AND x.item < y.item GROUP BY ALL HAVING count(*) >= {min_count})
SELECT a, b, cnt, round(cnt / (x.n + y.n - cnt)::DOUBLE, 6) AS strength FROM p JOIN m x ON x.item = a JOIN m y ON y.item = b
WHERE cnt / (x.n + y.n - cnt)::DOUBLE > {min_strength} {extra}"""


ORDERED_TYPES = "SELECT l_orderkey AS txn, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
ORDERED_BRANDS = "SELECT l_orderkey AS txn, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"


def ordered(spark: SparkSession, d: str, column: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", column)


@query(pairs_sql(ORDERED_TYPES, 3, 0.3))
def cooccur_type(spark, d):
    return assoc.cooccur(ordered(spark, d, "p_type"), ["l_orderkey"], "p_type", min_count=3, min_strength=0.3)


@query(pairs_sql("SELECT user_id || '/' || CAST(ts AS DATE) AS txn, event_type AS item FROM events", 2, 0.2))
def cooccur_events(spark, d):
    return assoc.cooccur(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type")


@query(pairs_sql(ORDERED_BRANDS, 2, 0.08))
def cooccur_brand(spark, d):
    return assoc.cooccur(ordered(spark, d, "p_brand"), ["l_orderkey"], "p_brand", min_strength=0.08)


@query(pairs_sql(ORDERED_BRANDS, 3, 0.05, "AND a[1:7] <> b[1:7] ORDER BY cnt / (x.n + y.n - cnt)::DOUBLE DESC, a, b LIMIT 5"))
def coupling_across(spark, d):
    """Pairs from unlike groups (here: the first brand digit), the five strongest."""
    pairs = assoc.cooccur(ordered(spark, d, "p_brand"), ["l_orderkey"], "p_brand", min_count=3, min_strength=0.05, group=F.substring("item", 1, 7))
    return pairs.orderBy(F.desc("strength"), "a", "b").limit(5)


@query(f"""
WITH p AS ({pairs_sql(ORDERED_BRANDS, 2, 0.05)}),
s AS (SELECT a AS item, b AS partner, cnt, strength FROM p UNION ALL SELECT b, a, cnt, strength FROM p)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY strength DESC, partner) = 1""")
def strongest_partner(spark, d):
    return assoc.strongest(assoc.cooccur(ordered(spark, d, "p_brand"), ["l_orderkey"], "p_brand", min_strength=0.05))


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS start FROM events WHERE event_type = 'error'),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY start RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAY FOLLOWING) AS n FROM e)
SELECT * FROM c WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start, n DESC) = 1""")
def rapid_edits(spark, d):
    return timewin.rapid_edits(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts")


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE datediff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) < 30 AND o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def active_areas(spark, d):
    return timewin.top_counts(timewin.recent(table(spark, d, "orders"), "o_orderdate", 30), "o_orderpriority", 5)


@query("""
SELECT l_partkey, count(*) AS n FROM lineitem
WHERE datediff('day', CAST(l_shipdate AS DATE), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) < 90 AND l_partkey IS NOT NULL
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20""")
def high_churn(spark, d):
    return timewin.top_counts(timewin.recent(table(spark, d, "lineitem"), "l_shipdate", 90), "l_partkey", 20)


@query("SELECT count(*) AS total, count(*) FILTER (url LIKE 'https://%') AS matching, round(avg(CAST(url LIKE 'https://%' AS INTEGER)), 6) AS share FROM pages")
def convention_share(spark, d):
    return timewin.share(table(spark, d, "pages"), F.col("url").startswith("https://"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT CAST(l_orderkey AS VARCHAR) AS label, n FROM g ORDER BY ts DESC, l_orderkey LIMIT 3)
SELECT * FROM t UNION ALL SELECT 'others', greatest(count(*) - 3, 0) FROM g HAVING count(*) > 3""")
def return_batches(spark, d):
    return timewin.batches(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_shipdate", 3, 3)


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return timewin.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


LINKS = """SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages"""


@query(f"SELECT src, dst, count(*) AS n FROM ({LINKS}) GROUP BY ALL")
def link_extract(spark, d):
    return extract.links(table(spark, d, "pages"), "page_id", "html").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS ({LINKS}), c AS (SELECT dst AS node, count(*) AS edges FROM e GROUP BY 1 HAVING count(*) >= CASE WHEN dst LIKE '%.py' THEN 3 ELSE 5 END),
n AS (SELECT count(*) AS n FROM (SELECT CAST(src AS VARCHAR) FROM e UNION SELECT dst FROM e)),
r AS (SELECT node, edges, CAST(row_number() OVER (ORDER BY edges DESC, node) AS INTEGER) AS rank FROM c)
SELECT node, edges, rank FROM r, n WHERE rank <= CASE WHEN n > 500 THEN 15 WHEN n > 100 THEN 10 ELSE 5 END""")
def hubs(spark, d):
    return graph.hubs(extract.links(table(spark, d, "pages"), "page_id", "html").withColumn("src", F.col("src").cast("string")))


@query(f"SELECT dst AS node, count(*) AS edges, count(DISTINCT src) AS importers FROM ({LINKS}) GROUP BY 1")
def fan_in(spark, d):
    return graph.fan_in(extract.links(table(spark, d, "pages"), "page_id", "html"))


TRADE = """SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


def trade(spark: SparkSession, d: str) -> DataFrame:
    """A multigraph of nations: from each line's customer to its supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


@query(f"""
WITH RECURSIVE e AS MATERIALIZED ({TRADE}), o AS (SELECT src, count(*) AS deg FROM e GROUP BY 1),
w AS MATERIALIZED (SELECT e.src, dst, count(*) / any_value(deg)::DOUBLE AS w FROM e JOIN o ON e.src = o.src GROUP BY e.src, dst),
r AS (SELECT 0 AS k, n_nationkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM nation) AS score FROM nation
      UNION ALL
      SELECT r.k + 1, n.n_nationkey, 0.15::DOUBLE / (SELECT count(*) FROM nation) + 0.85::DOUBLE * coalesce(sum(w.w * r.score), 0)
      FROM r CROSS JOIN nation n LEFT JOIN w ON w.src = r.node AND w.dst = n.n_nationkey WHERE r.k < 20 GROUP BY r.k, n.n_nationkey)
SELECT node, round(score, 6) AS score FROM r WHERE k = 20""")
def pagerank(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.pagerank(nodes, trade(spark, d)).select("node", F.round("score", 6).alias("score"))


@query("""
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN
(SELECT l_partkey FROM lineitem WHERE datediff('day', CAST(l_shipdate AS DATE), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) < 60 AND l_partkey IS NOT NULL)""")
def orphans(spark, d):
    """Parts that no order of the last sixty days asks for; orders have numbers of their own, below zero."""
    lines = timewin.recent(table(spark, d, "lineitem"), "l_shipdate", 60)
    return graph.orphans(table(spark, d, "part").select(F.col("p_partkey").alias("node")), lines.select((-F.col("l_orderkey")).alias("src"), F.col("l_partkey").alias("dst")))


@query(f"""
WITH n AS (SELECT src, dst, count(*) AS n FROM ({TRADE}) GROUP BY ALL), e AS MATERIALIZED (SELECT src, dst FROM n WHERE n >= (SELECT avg(n) FROM n)),
h AS (SELECT dst AS node FROM e GROUP BY 1 HAVING count(*) >= 14),
r AS (SELECT e.src, e.dst FROM e JOIN nation a ON e.src = a.n_nationkey JOIN nation b ON e.dst = b.n_nationkey
      WHERE a.n_regionkey = b.n_regionkey AND e.src IN (FROM h) AND e.dst NOT IN (FROM h))
SELECT src AS node, list_sort(list(dst)) AS members FROM r GROUP BY 1""")
def facades(spark, d):
    """Hub nations and the other nations of their own region that they lead to."""
    n = trade(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    e = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).where("n >= mean").select("src", "dst")
    hub = graph.fan_in(e).where("edges >= 14").select("node")
    region = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    # The folder of a node has to be a function of it; here it is looked up before and carried as the node's high part.
    a, b = (region.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(f"r{c}")) for c in ("src", "dst"))
    wide = e.join(a, "src").join(b, "dst").select((F.col("rsrc") * 1000 + F.col("src")).alias("src"), (F.col("rdst") * 1000 + F.col("dst")).alias("dst"))
    hub = hub.join(region, F.col("node") == F.col("n_nationkey")).select((F.col("n_regionkey") * 1000 + F.col("node")).alias("node"))
    out = graph.facades(wide, hub, F.lit(True), F.floor(F.col("node") / 1000))
    return out.select((F.col("node") % 1000).cast(e.schema["src"].dataType).alias("node"), F.array_sort(F.transform("members", lambda m: (m % 1000).cast(e.schema["src"].dataType))).alias("members"))


@query(f"""
WITH e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM ({TRADE}) GROUP BY ALL), t AS (SELECT DISTINCT src, dst FROM e WHERE n >= (SELECT avg(n) FROM e) AND src <> dst),
h AS (SELECT dst AS node FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
f AS (SELECT s_nationkey AS node FROM supplier GROUP BY 1 HAVING avg(s_acctbal) < 4000),
c AS (SELECT dst AS node, count(DISTINCT src) AS dependents FROM t GROUP BY 1)
SELECT node, dependents, node IN (FROM h) AS hub, node IN (FROM f) AS fragile,
       CASE WHEN node IN (FROM h) OR dependents >= 10 THEN 'high' WHEN node IN (FROM f) OR dependents >= 5 THEN 'medium' ELSE 'low' END AS risk FROM c""")
def blast_radius(spark, d):
    n = trade(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    e = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).where("n >= mean AND src <> dst").select("src", "dst")
    hub = graph.fan_in(e).orderBy(F.desc("edges"), "node").limit(3).select("node")
    fragile = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.avg("s_acctbal").alias("m")).where("m < 4000").select("node")
    return graph.blast_radius(e, fragile, hub)


@query(f"""
WITH c AS (SELECT dst AS node, CAST(row_number() OVER (ORDER BY count(*) DESC, dst) AS INTEGER) AS rank FROM ({TRADE}) GROUP BY 1),
r AS (SELECT *, CASE WHEN rank <= 1 THEN 0 WHEN rank <= 4 THEN 1 WHEN rank <= 8 THEN 2 WHEN rank <= 14 THEN 3 ELSE 4 END AS ring FROM c WHERE rank <= 22),
a AS (SELECT *, 2 * pi() * (rank - 1 - [0, 1, 4, 8, 14][ring + 1]) / [1, 3, 4, 6, 8][ring + 1] AS angle FROM r)
SELECT node, ring, round(ring * cos(angle), 6) + 0.0 AS x, round(ring * sin(angle) * 0.6, 6) + 0.0 AS y FROM a""")
def ring_layout(spark, d):
    from pyspark.sql import Window

    n = trade(spark, d).groupBy(F.col("dst").alias("node")).count()
    out = graph.ring_layout(n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "node"))))
    return out.select("node", "ring", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"""
WITH p AS (SELECT page_id, {PATH} AS path FROM pages)
SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', -1) AS base, split_part(path, '/', 1) AS top,
       CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 1) || '/…/' || split_part(path, '/', -1) ELSE path END AS short,
       lower(regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]*)$', 1)) AS ext FROM p""")
def path_parts(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    rows = table(spark, d, "pages").select("page_id", p.alias("path"))
    x = F.col("path")
    return rows.select("page_id", paths.dirname(x).alias("dir"), paths.basename(x).alias("base"), paths.top_dir(x).alias("top"), paths.shorten(x).alias("short"), paths.extension(x).alias("ext"))


@query(f"SELECT split_part({PATH}, '/', 2) AS top, count(*) AS n FROM pages GROUP BY 1")
def top_dirs(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    return table(spark, d, "pages").groupBy(paths.top_dir(p).alias("top")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
 '(?s)\"\"\".*?\"\"\"', '""', 'g'), '(?s)''''''.*?''''''', '''''', 'g'), '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')) AS n FROM pages""")
def strip_comments(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(text.strip_comments(F.col("html"))).cast("long").alias("n"))


@query(r"""
WITH e AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec FROM pages),
b AS (SELECT src, spec, regexp_replace(regexp_replace(spec, '^/', ''), '[.,]$', '') AS base FROM e),
k AS (SELECT DISTINCT split_part(url, '/', 4) || '/' || regexp_extract(html, '<h1>(\w+)', 1) AS path FROM pages),
t AS (SELECT src, spec, unnest(['en/' || base, 'de/' || base, 'fr/' || base, 'es/' || base]) AS path, unnest([0, 1, 2, 3]) AS pos FROM b)
SELECT src, spec, t.path AS dst FROM t JOIN k ON t.path = k.path QUALIFY row_number() OVER (PARTITION BY src, spec ORDER BY pos) = 1""")
def resolve_links(spark, d):
    """Each link resolved to the first folder that has a page whose heading starts with it."""
    pages = table(spark, d, "pages")
    known = pages.select(F.concat_ws("/", F.split_part("url", F.lit("/"), F.lit(4)), F.regexp_extract("html", r"<h1>([A-Za-z0-9_]+)", 1)).alias("path"))
    e = extract.links(pages, "page_id", "html").select("src", F.col("dst").alias("spec"))
    base = F.regexp_replace(F.regexp_replace("spec", "^/", ""), "[.,]$", "")
    return resolve.first_existing(e, F.array(*(F.concat(F.lit(x), base) for x in ("en/", "de/", "fr/", "es/"))), known)


PATTERNS = [
    ("licence", "apache", r"Apache License"), ("licence", "cc", r"CC BY"), ("licence", "any", r"(?i)licen[sc]ed|copyright"),
    ("contact", "mail", r"[a-z0-9.]+@[a-z0-9.]+"), ("contact", "ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("layout", "pipes", r" \| "), ("layout", "shout", r"!! "), ("layout", "marks", r"[$%&*#]{3}"),
]
LEAST = {"licence": 2, "contact": 3, "layout": 3}


@query(f"""
WITH p(family, name, regex) AS (VALUES {", ".join(f"('{f}', '{n}', '{r}')" for f, n, r in PATTERNS)}),
c AS (SELECT lang, family, name, count(*) FILTER (regexp_matches(coalesce(text, ''), regex)) AS n FROM documents, p GROUP BY ALL)
SELECT lang, family, name, n FROM c WHERE n >= CASE family WHEN 'licence' THEN 2 ELSE 3 END
QUALIFY row_number() OVER (PARTITION BY lang, family ORDER BY n DESC, name) = 1""")
def pattern_vote(spark, d):
    return vote.dominant(vote.tally(table(spark, d, "documents"), "text", PATTERNS, ["lang"]), LEAST, ["lang"])


@query("""
WITH n AS (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1 ORDER BY k DESC, 1 LIMIT 5),
s AS (SELECT s_suppkey, any_value(s_nationkey) AS nation, any_value(s_acctbal) AS bal, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
p AS (SELECT s_suppkey, parts, CASE WHEN parts >= 400 THEN 3 WHEN parts >= 300 THEN 2 WHEN parts >= 200 THEN 1 ELSE 0 END
      + CASE WHEN nation IN (SELECT s_nationkey FROM n) THEN 1 ELSE 0 END + CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS points FROM s)
SELECT *, CASE WHEN points >= 3 THEN 'high' WHEN points = 2 THEN 'medium' ELSE 'low' END AS confidence FROM p""")
def evidence_score(spark, d):
    suppliers = table(spark, d, "supplier")
    top = timewin.top_counts(suppliers, "s_nationkey", 5).select("s_nationkey", F.lit(1).alias("top"))
    parts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("parts"))
    rows = suppliers.join(parts, "s_suppkey").join(F.broadcast(top), "s_nationkey", "left")
    return vote.evidence(rows, F.col("parts"), F.coalesce("top", F.lit(0)), F.col("s_acctbal") > 5000, (200, 300, 400)).select("s_suppkey", "parts", "points", "confidence")


@query("""
WITH k AS (SELECT DISTINCT l_partkey FROM lineitem), r AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT l_partkey FROM r WHERE i % greatest(1, n // 50) = 0 ORDER BY i LIMIT 50""")
def stride_sample(spark, d):
    return vote.stride(table(spark, d, "lineitem"), "l_partkey", 50)


MODIFIED = "SELECT * FROM (VALUES ('ECONOMY', 0), ('LARGE', 1)) AS m(item, idx)"


@query(f"""
WITH p AS ({pairs_sql(ORDERED_TYPES, 3, 0.3)}), m AS ({MODIFIED}),
s AS (SELECT a AS item, b AS partner, strength FROM p UNION ALL SELECT b, a, strength FROM p),
e AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part),
w AS (SELECT dst AS item FROM e GROUP BY 1 HAVING count(DISTINCT src) >= 5),
f AS (SELECT partner AS target, idx, 1 AS sig, 'co-change' AS signal, CASE WHEN strength >= 0.5 THEN 'high' WHEN strength >= 0.3 THEN 'medium' ELSE 'low' END AS confidence, m.item AS cause, -strength AS ord
      FROM s JOIN m ON s.item = m.item
      UNION ALL SELECT src, idx, 2, 'import', 'medium', m.item, 0 FROM e JOIN m ON e.dst = m.item WHERE e.dst IN (FROM w)
      UNION ALL SELECT t, idx, 3, 'test', 'medium', m.item, pos FROM (SELECT DISTINCT p_type AS item, p_name AS t, 1 AS pos FROM part) JOIN m USING (item))
SELECT target, signal, confidence, cause FROM f WHERE target NOT IN (SELECT item FROM m)
QUALIFY row_number() OVER (PARTITION BY target ORDER BY idx, sig, ord, cause) = 1""")
def completeness(spark, d):
    part = table(spark, d, "part")
    pairs = assoc.partners(assoc.cooccur(ordered(spark, d, "p_type"), ["l_orderkey"], "p_type", min_count=3, min_strength=0.3))
    modified = spark.createDataFrame([("ECONOMY", 0), ("LARGE", 1)], "item string, idx int")
    edges = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    tests = part.select(F.col("p_type").alias("item"), F.col("p_name").alias("test"), F.lit(1).alias("pos")).distinct()
    return changes.completeness(modified, pairs, edges, tests)


@query(f"""
WITH p AS ({pairs_sql(ORDERED_BRANDS, 2, 0.05)}),
s AS (SELECT a AS item, b AS companion, strength FROM p UNION ALL SELECT b, a, strength FROM p),
t AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part),
u AS (SELECT item, companion, 1 AS stage, 'co-change' AS signal, least(0.8 * strength * 5, 0.6) AS points, false AS gated FROM s
      UNION ALL SELECT DISTINCT x.b, y.b, 2, 'sibling', 0.4, false FROM t x JOIN t y ON x.t = y.t AND x.b <> y.b
      UNION ALL SELECT DISTINCT x.p_brand, y.p_brand, 3, 'prefix', 0.35, true FROM part x JOIN part y ON x.p_brand[1:7] = y.p_brand[1:7] AND x.p_brand <> y.p_brand),
o AS (SELECT *, coalesce(min(CASE WHEN NOT gated THEN stage END) OVER q, 99) AS a, min(stage) OVER q AS b FROM u WINDOW q AS (PARTITION BY item, companion)),
g AS (SELECT item, companion, round(least(sum(points), 1.0), 6)::DOUBLE AS score, string_agg(signal, ',' ORDER BY stage) AS signals FROM o WHERE NOT gated OR stage = least(a, b) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, companion) AS INTEGER) AS rank FROM g WHERE score >= 0.3 QUALIFY rank <= 5""")
def companions(spark, d):
    pairs = assoc.partners(assoc.cooccur(ordered(spark, d, "p_brand"), ["l_orderkey"], "p_brand", min_strength=0.05))
    part = table(spark, d, "part")

    def signal(df, stage, name, points, gated):
        return df.select("item", "companion", F.lit(stage).alias("stage"), F.lit(name).alias("signal"), points.alias("points"), F.lit(gated).alias("gated"))

    one = signal(pairs.withColumnRenamed("partner", "companion"), 1, "co-change", F.least(F.lit(0.8) * F.col("strength") * 5, F.lit(0.6)), False)
    t = part.select("p_brand", "p_type").distinct()
    near = t.select(F.col("p_brand").alias("item"), "p_type").join(t.select(F.col("p_brand").alias("companion"), "p_type"), "p_type").where("item <> companion").select("item", "companion").distinct()
    b = part.select("p_brand", F.substring("p_brand", 1, 7).alias("prefix")).distinct()
    like = b.select(F.col("p_brand").alias("item"), "prefix").join(b.select(F.col("p_brand").alias("companion"), "prefix"), "prefix").where("item <> companion")
    signals = one.unionByName(signal(near, 2, "sibling", F.lit(0.4), False)).unionByName(signal(like, 3, "prefix", F.lit(0.35), True))
    return changes.companions(signals)


@query("""
WITH a AS (SELECT conv_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\pL]+'))) AS w FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\pL]+'))) AS w FROM conversations WHERE role = 'user'),
b AS (SELECT coalesce(a.conv_id, u.conv_id) AS conv_id, count(a.w) AS g, count(u.w) AS w, count(*) FILTER (a.w IS NOT NULL AND u.w IS NOT NULL) AS hits
      FROM (SELECT DISTINCT * FROM a WHERE w <> '') a FULL JOIN (SELECT DISTINCT * FROM u WHERE w <> '') u ON a.conv_id = u.conv_id AND a.w = u.w GROUP BY 1)
SELECT conv_id, hits, CASE WHEN w > 0 THEN round(hits / w::DOUBLE, 4) ELSE 0 END AS recall, CASE WHEN g > 0 THEN round(hits / g::DOUBLE, 4) ELSE 0 END AS precision,
       CASE WHEN g + w > 0 THEN round(2 * hits / (g + w)::DOUBLE, 4) ELSE 0 END AS f1 FROM b""")
def set_accuracy(spark, d):
    """How much of the user's vocabulary each conversation's answers take up."""
    rows = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("w <> ''")
    return changes.accuracy(rows.where("role = 'assistant'"), rows.where("role = 'user'"), "conv_id", "w")


@query("""
WITH s AS (SELECT doc_id AS pos, doc_id % 100 AS priority, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents),
r AS (SELECT *, sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY priority, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s)
SELECT pos, priority, tokens FROM r WHERE rest <= 20000 OR priority >= 90""")
def budget_drop(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") % 100).alias("priority"), text.tokens(F.col("n_chars")).alias("tokens"))
    return report.budget_by_priority(rows, 20_000)


@query("""
WITH l AS (SELECT lang, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
SELECT line, count(*) AS n FROM l WHERE lang = 'en' AND line <> '' AND line NOT IN (SELECT line FROM l WHERE lang <> 'en') GROUP BY line""")
def line_diff(spark, d):
    docs = table(spark, d, "documents")
    return report.new_lines(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "text")


@query("""
WITH p AS (SELECT doc_id, string_split_regex(text, '\\n') AS l FROM documents)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, CASE WHEN k = 1 THEN '' ELSE trim(split_part(s, chr(10), 1), ' ') END AS header,
       CASE WHEN k = 1 THEN trim(s, ' ') ELSE trim(CASE WHEN contains(s, chr(10)) THEN substr(s, strpos(s, chr(10)) + 1) ELSE '' END, ' ') END AS body
FROM (SELECT doc_id, unnest(string_split(x, chr(1))) AS s, unnest(range(1, len(string_split(x, chr(1))) + 1)) AS k
      FROM (SELECT doc_id, regexp_replace(text, '(?m)^The ', chr(1), 'g') AS x FROM documents)) WHERE k > 1 OR trim(s, ' ') <> ''""")
def text_sections(spark, d):
    """Documents in sections, each starting at a line that opens with `The `."""
    return report.sections(table(spark, d, "documents"), "doc_id", "text", "The ")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 4) AS sd,
       round(min(l_quantity), 4) AS low, round(max(l_quantity), 4) AS high FROM lineitem GROUP BY ALL""")
def run_stats(spark, d):
    return report.run_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


MEANS = "SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL"


@query(f"""
WITH m AS ({MEANS}), p AS (SELECT a.m - b.m AS d FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A')
SELECT count(*) FILTER (d > 0.5) AS wins, count(*) FILTER (abs(d) <= 0.5) AS ties, count(*) FILTER (d < -0.5) AS losses FROM p""")
def pairwise_wins(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return report.wins(means, "l_suppkey", "l_returnflag", "m", "R", "A", 0.5)


@query(f"SELECT l_suppkey, round(max(m) - min(m), 4) AS spread FROM ({MEANS}) GROUP BY 1 HAVING max(m) - min(m) > 0.5")
def divergence(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return report.divergence(means, "l_suppkey", "m", 0.5)


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def usage_rollup(spark, d):
    """Sums over a JSON map, as token counters are rolled up; malformed rows count as empty."""
    usage = F.from_json("props", "map<string,bigint>")
    total = F.aggregate(F.map_values(usage), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long")))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(total, F.lit(0))).alias("total"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def search(spark, d):
    return report.search(table(spark, d, "documents"), "license", "text", "source").select("doc_id", "lang", "source")


TOPICS = {"licence": ["license", "licensed", "copyright"], "speech": ["idiot", "stupid", "trash"], "contact": ["mail"]}


def _points(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(t, '\\b{w}\\b') THEN 2 WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words)


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS topic, {_points(w)} AS points FROM d WHERE {_points(w)} > 0" for n, w in TOPICS.items()))
def topic_match(spark, d):
    return report.topics(table(spark, d, "documents").select("doc_id", "text"), "text", TOPICS).select("doc_id", "topic", "points")


@query("""
WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM documents),
g AS (SELECT unnest([w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM w)
SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 5""")
def ngrams(spark, d):
    found = table(spark, d, "documents").select(text.words(F.coalesce("text", F.lit(""))).alias("w"))
    grams = found.select(F.explode_outer(text.ngrams(F.col("w"), 2)).alias("gram")).where("gram IS NOT NULL")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, md5(string_agg(role || '|' || md5(text), chr(10) ORDER BY role || '|' || md5(text))) AS fingerprint FROM c GROUP BY 1""")
def fingerprints(spark, d):
    """The order-free fingerprint by which a watcher tells whether a result has changed."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat_ws("|", "role", F.md5(F.col("text").cast("binary"))).alias("line"))
    return watch.fingerprint(rows, ["conv_id"], "line")


@query("""
WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, count(*) FILTER (k <= 10) AS allowed, count(*) FILTER (k > 10) AS rejected FROM e GROUP BY 1""")
def rate_limit(spark, d):
    return watch.clock_limit(table(spark, d, "events"), "user_id", "ts", "event_id", "hour", 10)


@query("""
WITH s AS (SELECT s_suppkey, s_name, any_value(s_acctbal) AS bal, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
f AS (SELECT s_suppkey, CASE WHEN bal < 0 THEN 'Fragile code' ELSE 'Style' END AS category, s_name AS description,
             CASE WHEN n >= 620 THEN 'high' WHEN n >= 590 THEN 'medium' ELSE 'low' END AS confidence FROM s)
SELECT s_suppkey, CASE WHEN confidence = 'medium' THEN 'supplementary' WHEN category = 'Fragile code' THEN 'critical' ELSE 'important' END AS tier
FROM f WHERE confidence <> 'low'""")
def finding_tiers(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "supplier").join(n, "s_suppkey")
    confidence = F.when(F.col("n") >= 620, "high").when(F.col("n") >= 590, "medium").otherwise("low")
    rows = rows.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "Fragile code").otherwise("Style").alias("category"), F.col("s_name").alias("description"), confidence.alias("confidence"))
    return rules.tiers(rows).select("s_suppkey", "tier")


@query("""
WITH b AS (SELECT DISTINCT p_type AS dir, p_brand AS x FROM part)
SELECT a.dir || '/' || a.x AS item, b.dir || '/' || b.x AS companion FROM b a JOIN b ON a.dir = b.dir AND a.x <> b.x
WHERE (starts_with(b.x, a.x) AND substr(b.x, length(a.x) + 1, 1) = upper(substr(b.x, length(a.x) + 1, 1)))
   OR (starts_with(a.x, b.x) AND substr(a.x, length(b.x) + 1, 1) = upper(substr(a.x, length(b.x) + 1, 1)))""")
def prefix_pairs(spark, d):
    """Names in one folder that extend one another."""
    p = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("path")).distinct()
    return context.prefix_pairs(p.withColumnRenamed("path", "item"), p)


@query("""
WITH f AS (SELECT DISTINCT 'p/' || p_partkey || '.ts' AS path FROM part),
h AS (SELECT 'p/' || l_partkey || '.ts' AS path, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS r FROM lineitem GROUP BY l_partkey),
t AS (SELECT f.path, CASE WHEN r <= 10 THEN 2 WHEN r <= 15 THEN 3 ELSE 4 END AS tier FROM f LEFT JOIN h USING (path)),
k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY path) - 1 AS k, count(*) OVER (PARTITION BY tier) AS n FROM t)
SELECT path, tier FROM k WHERE k % (CASE WHEN tier = 4 THEN greatest(1, n // 35) ELSE 1 END) = 0 ORDER BY tier, path LIMIT 50""")
def tiered_sample(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("p/"), "p_partkey", F.lit(".ts")).alias("path"))
    top = table(spark, d, "lineitem").groupBy("l_partkey").count().orderBy(F.desc("count"), "l_partkey").limit(15)
    from pyspark.sql import Window

    ranked = top.select(F.concat(F.lit("p/"), "l_partkey", F.lit(".ts")).alias("path"), F.row_number().over(Window.orderBy(F.desc("count"), "l_partkey")).alias("rank"))
    return rules.sample(files, 50, ranked, ranked.where("rank > 10").select("path", F.lit(1).alias("rank")))


from . import projects, repo_catalog  # noqa: E402, F401 - register their queries in the same tables
