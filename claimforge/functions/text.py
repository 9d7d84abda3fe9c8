"""String building blocks. Whitespace here is Unicode whitespace, as patent text uses U+3000."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regex for one Unicode white-space character.
WS = r"(?U:\s)"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Strips the given characters (a regex class body) from both ends."""
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def no_ws(c: Column | str) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def one_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_non_blank(*cs: Column | str) -> Column:
    """The first value that isn't blank, stripped; else the empty string."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return F.coalesce(out, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items of an array whose key no earlier item has, in order."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == i + 1)


def split_clean(c: Column, pattern: str) -> Column:
    """Stripped, non-blank parts of a split."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def keyword_list(c: Column) -> Column:
    """Parts at line breaks and commas, distinct in order."""
    return F.array_distinct(split_clean(c, r"[\n,，]+"))


def comma_union(lists: Column) -> Column:
    """The ordered distinct union of an array of comma lists, joined by ', '."""
    return F.array_join(F.array_distinct(F.flatten(F.transform(lists, lambda c: split_clean(c, ",")))), ", ")


def keyword_norm(c: Column) -> Column:
    """Lower case, full-width plus and dashes made plain, brackets and white space removed."""
    plain = F.translate(F.lower(c), "＋—–", "+--")
    return no_ws(F.regexp_replace(plain, r"[()（）\[\]【】]", ""))


def guard_norm(c: Column) -> Column:
    """Lower case without white space."""
    return no_ws(F.lower(F.coalesce(c, F.lit(""))))


def safe_file_name(c: Column) -> Column:
    """Letters, digits, dot, minus and underscore; all else becomes an underscore."""
    return F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")


def report_file_name(c: Column, limit: int = 80) -> Column:
    """Characters that file systems forbid become spaces, spaces become minus signs."""
    spaced = strip(F.regexp_replace(c, r'[<>:"/\\|?*]', " "))
    return F.left(F.regexp_replace(spaced, f"{WS}+", "-"), F.lit(limit))


def html_escape(c: Column) -> Column:
    """X49."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def shortened(c: Column, n: int) -> Column:
    """Names over n characters end in dots."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def string_array(c: Column) -> Column:
    """A JSON array of strings, or a bare string as the only item; blanks dropped."""
    parsed = F.from_json(F.when(F.startswith(strip(c), F.lit("[")), c), "array<string>")
    return F.filter(F.coalesce(parsed, F.array(c)), lambda x: x.isNotNull() & (strip(x) != ""))


def first_image(c: Column) -> Column:
    """J20."""
    return F.get(string_array(c), F.lit(0))
