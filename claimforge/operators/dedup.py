"""Order-aware dedup and merge (D1-D10). Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import breaks_guardrail
from ..functions.text import guard_norm, keyword_norm, no_ws, split_clean, strip

#: Scalar product fields that later rows fill when the first row has none; product_id is never filled.
FILLED = ("product_name", "product_url", "product_source", "price", "brand", "manufacturer", "description")


def keywords(df: DataFrame, group: str, seq: str = "seq", text: str = "keyword_text", confidence: str = "confidence_score") -> DataFrame:
    """Per group and normalized text one row: the most confident (the earliest of equals), at the
    place of the first. A single shuffle with map-side combining; null confidence counts as 0."""
    norm = keyword_norm(strip(F.coalesce(text, F.lit(""))))
    best = F.struct(F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).alias("c"), (-F.col(seq)).alias("s"))
    return (
        df.withColumn("norm", norm)
        .filter("norm <> ''")
        .groupBy(group, "norm")
        .agg(F.min(seq).alias("first_seq"), F.max_by(F.struct(strip(text).alias("t"), F.col(confidence).alias("c")), best).alias("row"))
        .select(group, F.col("first_seq").alias(seq), F.col("row.t").alias(text), F.col("row.c").alias(confidence))
    )


def guarded(df: DataFrame, group: str, seq: str = "seq", text: str = "keyword_text") -> DataFrame:
    """D3 after X46: keywords that pass the guardrails, the first of each normalized text."""
    first = F.row_number().over(Window.partitionBy(group, guard_norm(F.col(text))).orderBy(seq))
    return df.filter(~breaks_guardrail(F.col(text))).withColumn("rn", first).filter("rn = 1").drop("rn")


def product_key(df: DataFrame) -> DataFrame:
    """Adds key: by url, else by id, else by name and source as they are written."""
    full = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    by_name = F.concat(F.lit("name::"), strip(F.coalesce("product_name", F.lit(""))), F.lit("::"), strip(F.coalesce("product_source", F.lit(""))))
    return df.withColumn("key", F.coalesce(F.concat(F.lit("url::"), full("product_url")), F.concat(F.lit("id::"), full("product_id")), by_name))


def products(df: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """One row per key: the first row's values, empty ones (text, picture, raw_payload) filled from
    the next row that has one; matched_keywords is the ordered union, counted once a keyword before it is
    collected, so that a product found by millions of rows is no large array.

    Every row gives one row without a keyword, which carries the fields, and one for each keyword; both are combined before they
    are shuffled, and a second, small shuffle brings a product together."""
    keyed = product_key(df)
    kinds = dict(df.dtypes)
    names = [c for c in (*FILLED, "picture", "raw_payload") if c in df.columns]
    words = F.transform(split_clean(F.col("matched_keywords"), ","), lambda x, i: F.struct(x.alias("word"), i.alias("at")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("at")))
    rows = keyed.select(group, "key", F.col(seq).alias("_cf_seq"), "product_id", *names, F.explode(F.concat(none, words)).alias("w")).withColumn("word", F.col("w.word"))
    own = F.when(F.col("word").isNull(), F.col("_cf_seq"))
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True)) if kinds[c].startswith("array") else F.coalesce(F.col(c) == "", F.lit(True))
    filled = lambda c: F.coalesce(F.min_by(c, F.when(~empty(c), own)), F.min_by(c, own)).alias(c)
    fields = F.struct(F.min(own).alias(seq), F.min_by("product_id", own).alias("product_id"), *(filled(c) for c in names))
    counted = rows.groupBy(group, "key", "word").agg(F.min(F.struct("_cf_seq", "w.at")).alias("first"), fields.alias("fields"))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("first", "word")))), lambda x: x["word"])
    merged = counted.groupBy(group, "key").agg(F.max_by("fields", F.col("word").isNull()).alias("fields"), F.array_join(listed, ", ").alias("matched_keywords"))
    return merged.select(group, "key", "fields.*", "matched_keywords")


def last_wins(df: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The last value of each key, with the place of its first row."""
    return df.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.max_by(value, seq).alias(value))


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).filter("rn = 1").drop("rn")


def page_images(df: DataFrame, doc: str = "doc", page: str = "page", content: str = "content") -> DataFrame:
    """The first page of each rendered image of a document, by MD5."""
    return df.groupBy(doc, F.md5(content).alias("digest")).agg(F.min(page).alias(page))


def without_spaces(items, primary):
    """Distinct strings white space aside, but the primary one."""
    from ..functions.text import distinct_by

    return F.filter(distinct_by(items, no_ws), lambda x: no_ws(x) != no_ws(primary))
