"""Fill-in-the-middle transformation by a two-pass matcher in constant memory.

A text is a run of units, the matches of a pattern from left to right (code points by
default; words, lines and others by another pattern). The first pass counts them, and the
document's key hashes to two ranks among them. The second pass advances one lazy iterator of
matches, first to the smaller rank and then to the larger: the ends of those two matches cut
the text into prefix, middle and suffix. Neither pass keeps a match; beside the text a
document takes two counters and two offsets, however long it is.

Spark hashes the keys and builds and rebuilds the texts; tasks only find the cuts, each row
by itself. Nothing is shuffled, and a lost task repeats the same work.

Contract: a null text is the empty text; an empty text, one that holds a marker, and one in
``100 - share`` of 100 (by the key's hash) stay plain. A null key hashes as the empty text.
Repeated rows are transformed alike, each by itself; an empty table gives an empty one. Of
the input, only key and text are read, so other columns' names cannot clash. Text before
the first unit, between units and after the last one stays where it is: a rank of 0 is the
text's beginning, a rank of k the end of the k-th unit.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

#: One code point, line ends included.
CODE_POINT = r"(?s:.)"
#: Markers before prefix, suffix and middle. None may begin with the end of another.
MARKERS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = MARKERS


def units(pattern: re.Pattern, text: str) -> int:
    """How many units the text has; the matches pass by one at a time."""
    seen = count()
    deque(zip(pattern.finditer(text), seen, strict=False), maxlen=0)
    return next(seen)


def ends(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where units ``low`` and ``high`` (from 1, ascending; 0: the beginning) end."""
    matches = pattern.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def _cuts(docs: DataFrame, pattern: str) -> DataFrame:
    """Add ``n`` and, for rows with ranks to be found (``h1`` is not null), the two cuts in code points."""
    schema = "doc_id long, text string, spm boolean, n long, first long, second long"
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spm", pa.bool_()), ("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(pattern)
        for batch in batches:
            made = []
            for text, h1, h2 in zip(*(batch.column(c) for c in ("text", "h1", "h2")), strict=True):
                n, at = units(unit, own := text.as_py()), (None, None)
                if h1.is_valid:
                    at = ends(unit, own, *sorted((h1.as_py() % (n + 1), h2.as_py() % (n + 1))))
                made.append((n, *at))
            found = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(kinds.field(c).type) for c in ("doc_id", "text", "spm")), *found], schema=kinds)

    return in_arrow(docs, find, schema)


def transform(docs: DataFrame, pattern: str = CODE_POINT, seed: int = 1, share: int = 90, spm_share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every whole text, transformed.

    ``form`` is ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) or ``spm``. Of
    100 documents about ``share`` are cut, ``spm_share`` of 100 of those as ``spm``.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("key", 8 * i - 7, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.col("text").contains(marker)
    cut = (F.col("text") != "") & ~marked & (group(3) % 100 < share)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", key)
    asked = keyed.select("doc_id", "text", *[F.when(cut, group(i)).alias(f"h{i}") for i in (1, 2)], (cut & (group(4) % 100 < spm_share)).alias("spm"))
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    prefix, middle = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first)
    # One past the end is the empty text; a length that is too long ends with the text.
    suffix = F.substring("text", second + 1, F.lit((1 << 31) - 1))
    form = F.when(F.col("first").isNull(), "plain").when(F.col("spm"), "spm").otherwise("psm")
    output = F.when(F.col("first").isNull(), F.col("text")).when(F.col("spm"), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return _cuts(asked, pattern).select("doc_id", "n", form.alias("form"), F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: a cut text holds each marker once, so the first one found is it."""
    one, two = F.when(form == "spm", PREFIX).otherwise(SUFFIX), F.lit(MIDDLE)
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.lit((1 << 31) - 1))
    left, rest = F.split_part(body, one, F.lit(1)), F.split_part(body, one, F.lit(2))
    right, middle = F.split_part(rest, two, F.lit(1)), F.split_part(rest, two, F.lit(2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))


def oracle_sql(seed: int = 1) -> str:
    """The query's digests, with code points as units."""
    group = lambda i: f"CAST('0x' || substr(key, {8 * i - 7}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, {', '.join(f'{group(i)} AS h{i}' for i in (1, 2, 3, 4))} FROM d),
f AS (SELECT *, CASE WHEN text = '' OR {marked} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
c AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""
