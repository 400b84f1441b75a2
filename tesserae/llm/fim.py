"""Fill-in-middle: a text cut into prefix, middle and suffix at random code points, and put together in another order.

A text is bytes. Where all are ASCII, a code point is a byte and cuts are arithmetic. Else a sparse index of exceptions
holds only the multibyte characters: the code point and the byte at which each stands, and the running sum of the bytes that
it takes beyond one. searchsorted in it converts a cut in code points to one in bytes, and back, so texts are never decoded.

The cuts, the share of plain texts and the share of suffix-first ones come from the SHA-256 of a salt and the id, so that
reruns agree. Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text itself.
restore() puts the text together again.

Defined cases: a null text is an empty one; texts that are empty, or hold a marker, are plain; a null id is hashed like
an empty string; rows are cut one by one, so repeated rows give the same result; an empty table gives no rows; other
columns are ignored (formed) or kept (transform). In bytes that aren't UTF-8 a continuation byte without a start is a
character of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
SALT, FORMED, SUFFIX_FIRST = "1", 90, 20
FIELDS = "n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary"


class Exceptions(NamedTuple):
    """The multibyte characters of a text: their code points and bytes, and the excess bytes of those before each (and of all)."""

    points: np.ndarray
    starts: np.ndarray
    excess: np.ndarray

    def to_byte(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_point(self, starts: np.ndarray) -> np.ndarray:
        return starts - self.excess[np.searchsorted(self.starts, starts)]


NONE = Exceptions(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))


def exceptions(raw: bytes) -> Exceptions:
    if raw.isascii():
        return NONE
    more = (np.frombuffer(raw, np.uint8) & 0xC0) == 0x80
    starts = np.flatnonzero(more[1:] & ~more[:-1])
    follows = np.flatnonzero(more)
    ends = np.append(np.searchsorted(follows, starts), len(follows))
    excess = np.concatenate([[0], np.cumsum(np.diff(ends))])
    return Exceptions(starts - excess[:-1], starts, excess)


def split(raw: bytes, first: int, second: int) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """The code points of a text, and two cuts at remainders of two numbers: in code points, in order, and in bytes."""
    index = exceptions(raw)
    n = len(raw) - int(index.excess[-1])
    points = np.sort(np.array([first % (n + 1), second % (n + 1)], np.int64))
    cuts = index.to_byte(points)
    return n, (int(points[0]), int(points[1])), (int(cuts[0]), int(cuts[1]))


def together(raw: bytes, cuts: tuple[int, int], form: str, markers: tuple[bytes, ...]) -> bytes:
    p, s, m = markers
    prefix, middle, suffix = raw[: cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] :]
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def former(markers: tuple[str, ...] = MARKERS, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST):
    """A function from a text column and four columns of numbers to a struct of FIELDS."""
    marks = tuple(x.encode() for x in markers)

    @F.arrow_udf(FIELDS)
    def form(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, *numbers in batches:
            rows = []
            for raw, h1, h2, h3, h4 in zip(texts.cast(pa.large_binary()).to_pylist(), *(x.to_pylist() for x in numbers), strict=True):
                raw = raw or b""
                n, points, cuts = split(raw, h1, h2)
                if not raw or h3 % 100 >= formed or any(x in raw for x in marks):
                    rows.append((n, "plain", None, None, None, None, raw))
                else:
                    how = "spm" if h4 % 100 < suffix_first else "psm"
                    rows.append((n, how, points[0], points[1] - points[0], cuts[0], cuts[1] - cuts[0], together(raw, cuts, how, marks)))
            names, types = zip(*(x.split() for x in FIELDS.split(", ")), strict=True)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))

    return lambda text, *numbers: form(text.cast("string"), *numbers)


def numbers(doc_id: Column, salt: str = SALT) -> list[Column]:
    """Four unsigned 32-bit numbers: the first eight-digit groups of the SHA-256 of the salt, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, to: str = "fim", salt: str = SALT, markers: tuple[str, ...] = MARKERS, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a struct column `to`: n, form, prefix and middle in code points and bytes, and the output text."""
    made = former(markers, formed, suffix_first)(F.col("text"), *numbers(F.col("doc_id"), salt))
    return docs.withColumn(to, made).withColumn(to, F.col(to).withField("output", F.col(f"{to}.output").cast("string")))


def restore(output: Column, form: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The text that an output of that form was made of."""
    part = F.split(output, "|".join(f"\\Q{x}\\E" for x in markers), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def formed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, prefix_bytes, middle_bytes)."""
    rows = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    back = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"), "prefix_bytes", "middle_bytes")


SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
k AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS x, ('0x' || d[9:16])::BIGINT % (n + 1) AS y, ('0x' || d[17:24])::BIGINT % 100 AS z, ('0x' || d[25:32])::BIGINT % 100 AS s FROM h),
f AS (SELECT doc_id, text, n, least(x, y) AS p, greatest(x, y) AS q, CASE WHEN n = 0 OR z >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
c AS (SELECT *, substr(text, 1, p) AS a, substr(text, p + 1, q - p) AS m, substr(text, q + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256,
CASE WHEN form <> 'plain' THEN strlen(a) END AS prefix_bytes, CASE WHEN form <> 'plain' THEN strlen(m) END AS middle_bytes FROM c"""
