"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Lines are split at \\n and trimmed; lines without a word stay but form no window. Every window of
three consecutive lines is hashed (128 bits); of equal windows in all documents the first, by
(doc_id, place), stays, and the lines that later ones cover are removed, blank lines between included.

Edge cases: null text is empty; fewer than three lines with words make no window; rows equal in doc_id
and text are one document and get one result; a null doc_id comes first; an empty table gives an empty
result. Columns other than doc_id and text are ignored by dedup() and kept by deduped().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), first and last line of each window, and its hash."""
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANKS)).alias("t")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.filter(numbered, lambda x: x["t"] != "").alias("l"))
    at = lambda k, d: F.get(F.col("l"), k + d)
    window = lambda k: F.struct(at(k, 0)["i"].alias("first"), at(k, 2)["i"].alias("last"), F.xxhash64(at(k, 0)["t"], at(k, 1)["t"], at(k, 2)["t"]).alias("h1"), F.xxhash64(at(k, 2)["t"], F.lit("\n"), at(k, 1)["t"], F.lit("\n"), at(k, 0)["t"]).alias("h2"))
    return lines.filter(F.size("l") >= 3).select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - 3), window)).alias("w")).select("doc_id", "row", "w.*")


def covered(docs: DataFrame) -> DataFrame:
    """d_id, d_row and the sorted line numbers to remove, for documents that lose any."""
    w = windows(docs)
    place = F.struct("doc_id", "row", "first")
    firsts = w.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written first: so the join has a shuffle of its own for both sides, and a window that many documents share can be split.
    later = w.join(written(firsts, "firsts").hint("merge"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("origin")))
    numbers = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    return later.groupBy(F.col("doc_id").alias("d_id"), F.col("row").alias("d_row")).agg(F.collect_set(F.struct("first", "last")).alias("spans")).select("d_id", "d_row", F.sort_array(numbers).alias("gone"))


def _applied(docs: DataFrame) -> DataFrame:
    gone = written(covered(docs), "lines")
    named = docs.select(F.struct(*docs.columns).alias("_cf_row"), "doc_id", "text", F.xxhash64("text").alias("row"))
    # Always a merge join: the plan, and so its disk, is the same at every size.
    joined = named.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row") == F.col("d_row")), "left")
    lines = _lines(F.col("text"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    return joined.select("_cf_row", "doc_id", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("left"), F.size(lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without later copies of windows, n_lines before, n_removed."""
    return _applied(docs).select("doc_id", F.col("left").alias("text"), "n_lines", "n_removed")


def deduped(docs: DataFrame) -> DataFrame:
    """docs with the shortened texts (and n_chars, if there); a document that loses its last word goes."""
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    rows = _applied(docs).filter((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*(F.when(F.col("n_removed") == 0, F.col("_cf_row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("_cf_row")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
x AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM e),
w AS (SELECT doc_id, i AS s, lead(i, 2) OVER p AS l, t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS g
      FROM x WHERE t <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, s, l, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w WHERE l IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(s, l + 1)) AS i FROM r WHERE k > 1)
SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE c.i IS NULL), '') AS text,
       count(*)::BIGINT AS n_lines, count(c.i)::BIGINT AS n_removed
FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id
"""
