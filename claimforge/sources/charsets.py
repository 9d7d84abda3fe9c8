"""Charset of files by their bytes (S8): UTF-8, UTF-16 with and without mark, GB18030, Big5, Shift-JIS.

A byte order mark decides, and so do bytes that are UTF-8; zero bytes leave only UTF-16. Of the other charsets those in which the bytes
are well-formed are compared by how usual the characters are that come out: the first level of the three national sets
holds each language's common characters, and letters rarely touch ideographs. Bytes that fit nothing, or only as rare
characters, give an error in a column of its own, never in the text.

Whole files are judged, in Arrow batches; Spark's own decode() knows only the Unicode charsets, so texts are decoded there too."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Charsets that are compared, and the first and last lead byte of their first level.
NATIONAL = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "shift_jis": (0x88, 0x98)}
#: What a character outside ASCII costs: common ones, Latin letters with marks, rare ideographs, half-width kana, and what no text has.
COMMON, LETTER, RARE, HALF, ODD = 0.0, 0.5, 2.0, 3.0, 8.0
#: An ASCII letter beside an ideograph or kana costs this, and UTF-16 that shows no zero byte this a character.
TOUCH, BLIND = 1.5, 1.0
#: A mean cost over this is no text.
MOST = 4.0
UNDECIDED = "CHARSET_UNDECIDED"


@functools.cache
def costs(charset: str) -> np.ndarray:
    """Cost of every character of the basic plane in a charset."""
    cost = np.full(1 << 16, RARE)
    cost[0x00A0:0x0250] = LETTER
    cost[0x0370:0x0530] = LETTER
    cost[0x2010:0x2040] = cost[0x3000:0x3020] = cost[0xFF01:0xFF5F] = COMMON
    cost[0xFF61:0xFFA0] = HALF
    cost[0xD800:0xF900] = cost[0x80:0xA0] = cost[0xFFF0:] = ODD
    for name, (low, high) in NATIONAL.items():
        if charset not in (name, "utf-16-le", "utf-16-be"):
            continue
        for lead in range(low, high + 1):
            for trail in range(0x40, 0xFF):
                if len(c := bytes((lead, trail)).decode(name, "ignore")) == 1:
                    cost[ord(c)] = COMMON
        if name == "shift_jis":
            cost[0x3041:0x3100] = COMMON
    return cost


def mean_cost(text: str, charset: str) -> float:
    """Mean cost of the characters outside ASCII, and of control characters; 0 without any."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    control = (code < 32) & ~np.isin(code, (9, 10, 12, 13))
    wide = code >= 128
    if not (wide | control).any():
        return 0.0
    cost = np.where(code < 1 << 16, costs(charset)[np.minimum(code, 0xFFFF)], RARE + 1)
    east = (code >= 0x3040) & (code < 0xA000)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    touches = np.zeros(len(code))
    touches[1:] += east[1:] & letter[:-1]
    touches[:-1] += east[:-1] & letter[1:]
    return float((cost[wide].sum() + ODD * control.sum() + TOUCH * touches[east].sum()) / (wide.sum() + control.sum()))


def _decoded(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(charset)
    except UnicodeDecodeError:
        return None


def detected(data: bytes | None) -> tuple[str | None, str | None, str | None]:
    """charset, text and error of a file's bytes; null bytes are null, no bytes are an empty UTF-8 text."""
    if data is None:
        return None, None, None
    for mark, charset in MARKS:
        if data.startswith(mark):
            text = _decoded(data[len(mark) :], charset)
            return (charset, text, None) if text is not None else (None, None, UNDECIDED)
    zeros = np.frombuffer(data, np.uint8) == 0
    if zeros.any():
        even, odd = int(zeros[::2].sum()), int(zeros[1::2].sum())
        # An ASCII letter's zero byte tells the order; ideographs such as U+4E00 have one on the other side.
        tries = [("utf-16-le", 0.0), ("utf-16-be", 0.0)][:: 1 if odd >= even else -1]
    else:
        text = _decoded(data, "utf-8")
        if text is not None and mean_cost(text, "utf-8") < ODD:
            return "utf-8", text, None
        tries = [*((c, 0.0) for c in NATIONAL), ("utf-16-le", BLIND), ("utf-16-be", BLIND)]
    found = [(mean_cost(text, c) + more, i, c, text) for i, (c, more) in enumerate(tries) if (text := _decoded(data, c)) is not None]
    if not found or min(found)[0] > MOST:
        return None, None, UNDECIDED
    _, _, charset, text = min(found)
    return charset, text, None


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("charset", "text", "error")]))
def _detect(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detected(x) for x in contents], columns=["charset", "text", "error"], dtype=object)


def charset_text(content: Column) -> Column:
    """Struct of charset, text and error of binary content."""
    return _detect(content)


def texts(files: DataFrame) -> DataFrame:
    """Path, charset, raw_text and read_error of files with their bytes."""
    found = files.select("path", charset_text(F.col("content")).alias("f"))
    return found.select("path", "f.charset", F.col("f.text").alias("raw_text"), F.col("f.error").alias("read_error"))
