"""Fill-in-middle transformation: texts cut at unit ends and put in prefix-suffix-middle or suffix-prefix-middle order.

One pandas UDF over Arrow batches. The end offsets of a text's units go into a compact array while finditer runs, so
each of the three parts is a slice between two looked-up offsets. Cuts, form and order come from a SHA-256 of the
doc_id, so they are the same in every run and on every executor.

Edge cases: null text is empty; an empty text, or one that contains a marker, stays plain, as does a share of the
others; a null doc_id is seeded with no digits; rows equal in doc_id and text get equal results; an empty table gives
an empty result. Columns other than doc_id and text are ignored by transform() and kept by transformed(), whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Of 100 texts so many aren't plain, and of 100 of those so many have the suffix first.
CUT_SHARE, SPM_SHARE = 90, 20
SALT = "1:"
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def seeds(doc_id: int | None, salt: str = SALT) -> list[int]:
    """The first four 8-digit groups of the hex digest."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("Q", (m.end() for m in _UNIT.finditer(text)))


def restore(output: str, form: str) -> str:
    """The text of an output. Parts hold no marker, and none can arise where a part and a marker meet."""
    if form == "plain":
        return output
    first, rest = output[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX, 1)
    second, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def _one(doc_id: int | None, text: str, cut_share: int, spm_share: int) -> tuple:
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= cut_share:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_UNIT = regex.compile(UNIT)


def arranged(doc_id: Column, text: Column, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> Column:
    """A struct of FIELDS."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    @F.pandas_udf(FIELDS)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        # Ids come as text: a null among integers would turn the column into floats.
        for i, t in zip(ids, texts, strict=True):
            n, form, before, within, output = _one(i, t, cut_share, spm_share)
            rows.append((n, form, before, within, output, sha(output), sha(restore(output, form))))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")], dtype=object)

    return run(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def transform(docs: DataFrame, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, and the digests of the output and of the text rebuilt from it."""
    return docs.select("doc_id", arranged(F.col("doc_id"), F.col("text"), cut_share, spm_share).alias("f")).select("doc_id", "f.*")


def transformed(docs: DataFrame, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The documents with the output as their text."""
    found = docs.select(F.struct(*docs.columns).alias("_cf_row"), arranged(F.col("doc_id"), F.col("text"), cut_share, spm_share)["output"].alias("_cf_output"))
    return found.select(*(F.col("_cf_output").alias(c) if c == "text" else F.col("_cf_row")[c].alias(c) for c in docs.columns))


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
sha256(prefix || middle || suffix) AS restored_sha256 FROM p
"""
