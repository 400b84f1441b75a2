"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts and benchmark items become token templates: a number is <num>, a unit after a number <unit>, a capitalised
word <name>, any other word its lower-case form; punctuation is dropped. Windows of `words` tokens with at least
`words - slots` literal ones are hashed and joined with the item's windows. A match also says what each slot holds
on both sides: along one alignment of an item with a document, each item value has to stand for one document value
throughout (consistent slots), so a question asked again with other numbers or names is caught and a chance meeting
of templates is not. An item value that stands for several document values takes away those windows that hold it and
differ from the item; case never makes a difference.

Windows are also joined by their lower-case words, slot-heavy ones included: these count wherever they meet, so a copy
in capitals, in lower case, or of an item of numbers or in capitals, is found. An item is leaked into a document where
matched windows cover `coverage` of those that may match by template, or windows of either kind `coverage` of all. (So
an item of slots only is found verbatim, in any case, but not under other numbers: such a template says nothing.)

A first pass joins hashes alone: a window is (doc_id, hash of the text, number, hash), an item's window a hash and three
numbers. Items whose matched windows can't reach `coverage` in a document are left out there, as what follows only takes
matches away. Texts are met again for the windows that remain, once a document, to hold tokens against tokens. The
documents' windows stream through the first join while the items' are no more than `most` rows of fixed size (counted);
beyond that both sides are shuffled by hash and one of `SALTS` salts, so that a hot window is dealt out. The windows to
look at again are broadcast up to `most_bytes` (counted), else texts are shuffled once.

Defined cases: null or empty texts have no windows; items with fewer tokens than a window can't be matched; rows
that share a doc_id, null ids included, are judged as one document; repeated items count once for each item_id; an
empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SLOTS, COVERAGE, MOST, MOST_BYTES, SALTS = 5, 2, 0.8, 500_000, 128 << 20, 16
TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*|[%$€£°]"
# The units that are recognised after a number.
UNITS = "mm cm m km g kg mg t lb lbs oz in ft yd mi mph kmh s sec min h hr hrs ms l ml gal % $ € £ ° c f k usd eur gbp dollars euros cents percent inches feet yards miles meters metres kilometers kilometres grams kilograms pounds ounces liters litres seconds minutes hours days weeks months years degrees".split()


def canonical(raw: Column) -> Column:
    """The template of an array of tokens."""

    def form(token: Column, at: Column) -> Column:
        first = F.substring(token, 1, 1)
        previous = F.substring(F.get(raw, at - 1), 1, 1)
        low = F.lower(token)
        return (
            F.when(first.between("0", "9"), "<num>")
            .when((at > 0) & previous.between("0", "9") & low.isin(UNITS), "<unit>")
            .when(first != F.lower(first), "<name>")
            .otherwise(low)
        )

    return F.transform(raw, form)


def tokens(rows: DataFrame) -> DataFrame:
    """rows with raw, the tokens of text, and template, their canonical forms followed by their lower-case ones.

    No filter may stand above this, or be inferred from a join or comparison there, but on what the outer form explodes:
    Catalyst would push it below the projections and work out the tokens again inside every step of the lambdas.
    """
    rows = rows.withColumn("raw", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN), F.lit(0))).drop("text")
    rows = rows.withColumn("template", canonical(F.col("raw")))
    return rows.withColumn("template", F.concat("template", F.transform("raw", F.lower)))


def run(array: str, at: Column, words: int) -> list[Column]:
    """The words elements of the array from at (0 is its first): a slice would copy the whole array for each window."""
    return [F.get(F.col(array), at + k if k else at) for k in range(words)]


def hashes(words: int) -> Column:
    """Of each window of tokens(), that of the canonical tokens from each place and then of the lower-case ones, which also hash a mark; null if there is none."""
    last = F.size("raw") - words + 1
    canon = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*run("template", i, words)))
    lower = F.transform(F.sequence(F.size("raw"), F.size("raw") + last - 1), lambda i: F.xxhash64(*run("template", i, words), F.lit(True)))
    return F.when(last > 0, F.concat(canon, lower))


def place(n: Column, words: int) -> tuple[Column, Column, Column]:
    """Of the hash numbered n: whether it is of lower-case tokens, its window's token, and that token's place in template."""
    last = F.size("raw") - words + 1
    equal = n >= last
    return equal, F.when(equal, n - last).otherwise(n), F.when(equal, n + words - 1).otherwise(n)


def renamed(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """right with the keys renamed, and the null-safe condition that joins them with another table's."""
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns)), match


def covered(found: DataFrame, totals: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, item_id, best, reworded) of found (doc_id, item_id, at, equal, reworded) where enough of the item is covered."""
    found = found.groupBy("doc_id", F.col("item_id").alias("_item"), "at").agg(F.min("equal").alias("equal"), F.max("reworded").alias("reworded"))
    found = found.groupBy("doc_id", "_item").agg(F.count_if(~F.col("equal")).alias("matched"), F.count(F.lit(1)).alias("all_matched"), F.max("reworded").alias("reworded"))
    found = found.join(totals, F.col("_item").eqNullSafe(F.col("item_id")))
    # The better covered of the two: the windows that may match by template, and all.
    sides = [F.struct(F.try_divide(m, w).alias("share"), F.col(m).alias("matched"), F.col(w).alias("windows")) for m, w in (("matched", "windows"), ("all_matched", "all_windows"))]
    return found.select("doc_id", "item_id", F.greatest(*sides).alias("best"), "reworded").where(F.col("best.share") >= coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, slots: int = SLOTS, coverage: float = COVERAGE, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, reworded): each item leaked into each document."""
    text = F.col("text").cast("string").alias("text")
    item = tokens(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text))
    item = item.select("item_id", "raw", "template", F.posexplode_outer(hashes(words)).alias("n", "hash"))
    equal, at, start = place(F.col("n"), words)
    item = item.select("item_id", equal.alias("equal"), at.alias("at"), "hash", F.array(*run("template", start, words)).alias("window"), F.array(*run("raw", at, words)).alias("said"))
    item = common.cut(item).where("hash IS NOT NULL")
    item = common.cut(item.where(F.size(F.filter("window", lambda x: x.startswith("<"))) <= slots).distinct())
    totals = item.groupBy("item_id", "at").agg(F.min("equal").alias("equal")).groupBy("item_id").agg(F.count_if(~F.col("equal")).alias("windows"), F.count(F.lit(1)).alias("all_windows"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text)
    doc = tokens(rows).withColumn("hashes", hashes(words)).select("doc_id", "text_id", F.posexplode_outer("hashes").alias("n", "hash"))
    keys = item.select("hash", "equal", "item_id", "at").distinct()
    if keys.count() <= most:
        met = doc.join(F.broadcast(keys), "hash")
    else:
        doc = doc.where("hash IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_id", "n"), F.lit(SALTS)).cast("int"))
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = doc.join(keys, ["hash", "salt"])
    met = common.cut(met.select("doc_id", "text_id", "n", "hash", "equal", "item_id", "at").distinct())
    likely, match = renamed(covered(met.withColumn("reworded", F.lit(False)), totals, coverage).select("doc_id", "item_id"), ["doc_id", "item_id"])
    met = common.cut(met.join(likely, match, "left_semi"))

    look = common.cut(met.groupBy("doc_id", "text_id").agg(F.collect_set("n").alias("places")))  # no more than the text has
    held = look.agg(F.sum(64 + 8 * F.size("places"))).first()[0] or 0
    look, match = renamed(look, ["doc_id", "text_id"])
    seen = tokens(rows.join(F.broadcast(look) if held <= most_bytes else look, match).select("doc_id", "text_id", "text", "places"))

    def window(n: Column) -> Column:
        _, pos, start = place(n, words)
        return F.struct(n.alias("n"), pos.alias("pos"), F.array(*run("raw", pos, words)).alias("seen"), F.array(*run("template", start, words)).alias("form"))

    seen = seen.select("doc_id", "text_id", F.explode_outer(F.transform("places", window)).alias("w")).select("doc_id", "text_id", "w.*").distinct()
    seen, match = renamed(seen, ["doc_id", "text_id", "n"])
    met = met.join(seen, match)
    side, match = renamed(item, ["hash", "equal", "item_id", "at"])
    met = met.join(side, match).where(F.col("form") == F.col("window"))
    pairs = F.filter(F.arrays_zip("window", "said", "seen"), lambda x: x["window"].startswith("<"))
    met = common.cut(met.select("doc_id", "item_id", "equal", "at", (F.col("pos") - F.col("at")).alias("shift"), F.transform(pairs, lambda x: F.struct(F.lower(x["said"]).alias("said"), F.lower(x["seen"]).alias("seen"))).alias("slots")))
    along = ["doc_id", "item_id", "shift"]
    differs = F.exists("slots", lambda x: x["said"] != x["seen"])
    filled = met.where(differs).select(*along, F.explode("slots").alias("slot")).groupBy(*along, "slot.said").agg(F.min("slot.seen").alias("low"), F.max("slot.seen").alias("high"))
    torn = filled.groupBy(*along).agg(F.collect_set(F.when(F.col("low") != F.col("high"), F.col("said"))).alias("torn"), F.max(F.col("low") != F.col("said")).alias("reworded"))
    torn, match = renamed(torn, along)
    gone = differs & F.arrays_overlap(F.col("slots")["said"], "torn")
    met = met.join(torn, match, "left").where(~F.coalesce(gone, F.lit(False)))
    found = covered(met.withColumn("reworded", F.coalesce("reworded", F.lit(False)) & ~F.col("equal")), totals, coverage)
    return found.select("doc_id", "item_id", "best.matched", "best.windows", F.round("best.share", 6).alias("coverage"), "reworded")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs into which no item is leaked."""
    name = common.prefix_for(docs) + "leaked"
    found = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


def _side(table: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
{key}_raw AS (SELECT CAST({key} AS BIGINT) AS {key}, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS raw FROM {table}),
{key}_tok AS MATERIALIZED (SELECT {key}, [lower(x) FOR x IN raw] AS low, [CASE WHEN raw[i][1] BETWEEN '0' AND '9' THEN '<num>'
    WHEN i > 1 AND raw[i - 1][1] BETWEEN '0' AND '9' AND lower(raw[i]) IN ({units}) THEN '<unit>'
    WHEN raw[i][1] <> lower(raw[i][1]) THEN '<name>' ELSE lower(raw[i]) END FOR i IN range(1, len(raw) + 1)] AS template FROM {key}_raw),
{key}_pos AS (SELECT *, unnest(range(0, len(low) - {WORDS} + 1)) AS pos FROM {key}_tok WHERE len(low) >= {WORDS})"""


SQL = f"""
WITH {_side("documents", "doc_id")}, {_side("benchmark", "item_id")},
item AS (SELECT DISTINCT item_id, pos AS place, false AS equal, template[pos + 1 : pos + {WORDS}] AS win, low[pos + 1 : pos + {WORDS}] AS said FROM item_id_pos
         WHERE len([x FOR x IN template[pos + 1 : pos + {WORDS}] IF x[1] = '<']) <= {SLOTS}
         UNION SELECT item_id, pos, true, low[pos + 1 : pos + {WORDS}], low[pos + 1 : pos + {WORDS}] FROM item_id_pos),
win AS (SELECT doc_id, pos, false AS equal, template[pos + 1 : pos + {WORDS}] AS win, low[pos + 1 : pos + {WORDS}] AS seen FROM doc_id_pos
        UNION ALL SELECT doc_id, pos, true, low[pos + 1 : pos + {WORDS}], low[pos + 1 : pos + {WORDS}] FROM doc_id_pos),
met AS MATERIALIZED (SELECT DISTINCT d.doc_id, i.item_id, i.place, d.pos - i.place AS shift, i.equal, i.win, i.said, d.seen,
        NOT i.equal AND i.said <> d.seen AS differs FROM win d JOIN item i ON d.equal = i.equal AND d.win = i.win),
slot AS (SELECT doc_id, item_id, shift, said[k] AS said, min(seen[k]) AS low, max(seen[k]) AS high
         FROM (SELECT *, unnest(range(1, len(win) + 1)) AS k FROM met WHERE differs) WHERE win[k][1] = '<' GROUP BY ALL),
torn AS (SELECT doc_id, item_id, shift, list(said) FILTER (low <> high) AS torn, bool_or(low <> said) AS reworded FROM slot GROUP BY ALL),
kept AS (SELECT m.*, coalesce(reworded, false) AS reworded
         FROM met m LEFT JOIN torn t ON m.doc_id IS NOT DISTINCT FROM t.doc_id AND m.item_id IS NOT DISTINCT FROM t.item_id AND m.shift = t.shift
         WHERE NOT (differs AND list_has_any([m.said[k] FOR k IN range(1, len(m.said) + 1) IF m.win[k][1] = '<'], coalesce(torn, [])))),
found AS (SELECT doc_id, item_id, place, bool_and(equal) AS equal, bool_or(reworded AND NOT equal) AS reworded FROM kept GROUP BY ALL),
sums AS (SELECT doc_id, item_id, count(*) FILTER (NOT equal) AS matched, count(*) AS all_matched, bool_or(reworded) AS reworded FROM found GROUP BY ALL),
totals AS (SELECT item_id, count(*) FILTER (NOT equal) AS windows, count(*) AS all_windows
           FROM (SELECT item_id, place, bool_and(equal) AS equal FROM item GROUP BY ALL) GROUP BY item_id),
best AS (SELECT doc_id, s.item_id, reworded, CASE WHEN windows > 0 AND matched / windows::DOUBLE >= all_matched / all_windows::DOUBLE AND
           (matched / windows::DOUBLE > all_matched / all_windows::DOUBLE OR matched > all_matched) THEN matched ELSE all_matched END AS matched,
         CASE WHEN windows > 0 AND matched / windows::DOUBLE >= all_matched / all_windows::DOUBLE AND
           (matched / windows::DOUBLE > all_matched / all_windows::DOUBLE OR matched > all_matched) THEN windows ELSE all_windows END AS windows
         FROM sums s JOIN totals t ON s.item_id IS NOT DISTINCT FROM t.item_id)
SELECT doc_id, item_id, matched, windows, round(matched / windows::DOUBLE, 6) AS coverage, reworded FROM best WHERE matched / windows::DOUBLE >= {COVERAGE}
"""
