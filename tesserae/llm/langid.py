"""Language ID by compression: the language whose raw-content zstandard dictionary shrinks a text most.

Training keeps, for each language, the first `per_lang` labelled texts in hash order of their ids (a bounded,
documented sample that does not depend on partitioning), of each an eighth of `dict_bytes` at most so that one long
text doesn't fill it, and concatenates their words to `dict_bytes` at most. These bounds are on fitting alone.
Of a whole text, the distinct lower-cased words (in order of appearance, letters only) are compressed with each
dictionary, so repetition doesn't drown the evidence; the score is the relative margin between the best and the
second-best size, and a text is rejected where that is below `margin`. Of every text, whatever its length, the words
are said TIMES over: zstandard stores what it can't shrink and would hide the size of a few words said once.

Defined cases: a null text, or one without letters, is `und` with score 0; an empty training set makes every text
`und`; with a single language the score of every text with letters is 1; ties go to the smaller language name;
rows of a null lang, or without letters, are not learned from; repeated rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICT_BYTES, PER_LANG, LEVEL, MARGIN = 16 * 1024, 96, 5, 0.004
UNKNOWN, TIMES = "und", 8
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> bytes:
    return (" " + " ".join(dict.fromkeys(LETTERS.findall(text.lower()))) + " ").encode("utf-8", "replace")


def probe(text: str) -> bytes:
    """What is compressed."""
    return words(text) * TIMES


def packers(content: dict[str, bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    """One for each language; three-byte matches, as words here are short."""
    tune = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
    out = []
    for x in content.values():
        d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=tune)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=tune))
    return out


def dictionaries(docs: DataFrame, train: Column, dict_bytes: int = DICT_BYTES, per_lang: int = PER_LANG) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows where train holds; per_lang texts of dict_bytes at most each."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    # Only the cut texts of the sample leave the scan: row_number() <= k keeps k rows a language in each task.
    rows = rows.select("doc_id", "lang", F.substring("text", 1, dict_bytes // 8).alias("text"))
    sample = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_lang).orderBy("lang", "k")
    out: dict[str, bytes] = {}
    for lang, text in sample.select("lang", "text").collect():
        out[lang] = (out.get(lang, b"") + words(text))[-dict_bytes:]
    return dict(sorted(out.items()))


def detector(content: dict[str, bytes], level: int = LEVEL):
    """A function from a text column to a struct of lang_pred and score."""
    names = list(content)

    @F.arrow_udf("lang_pred string, score double")
    def detect(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by = packers(content, level)

        def judge(text: str | None) -> tuple[str, float]:
            raw = probe(text or "")
            if not by or not raw.strip():
                return UNKNOWN, 0.0
            sizes = [len(p.compress(raw)) for p in by]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            rest = min((s for k, s in enumerate(sizes) if k != best), default=None)
            return names[best], 1.0 if rest is None else (rest - sizes[best]) / max(1, rest)

        for array in arrays:
            got = [judge(x) for x in array.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["lang_pred", "score"])

    return lambda text: detect(text.cast("string"))


def identify(docs: DataFrame, content: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs; rejected where the margin is too narrow."""
    rows = docs.select("doc_id", detector(content, level)(F.col("text")).alias("v"))
    return rows.select("doc_id", "v.lang_pred", "v.score", ((F.col("v.lang_pred") == UNKNOWN) | (F.col("v.score") < margin)).alias("rejected"))


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32(doc_id as text) mod folds is the fold; a null id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language the texts tell by at least the margin, learned from all labelled rows."""
    v = detector(dictionaries(docs, F.lit(True)))(F.col("text"))
    return docs.where((v["lang_pred"] != UNKNOWN) & (v["score"] >= margin))
