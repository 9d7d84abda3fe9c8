"""Mixing sources to target weights by capped water-filling.

Sources in code point order (null last) weigh ``weights`` in turn. Every source asks for its share of
all words; no source may give more than ``max_epochs`` times its own words, and what a full source
cannot give is shared again by weight. Sorted by capacity per unit of weight the full sources come
first, so one running sum over the source table finds the level: no loop.

A source whose target is r times its size gives floor(r) whole repetitions of every document and one
more of a seeded selection: documents in the order of md5(seed, doc_id) while the words so far stay
nearest to the remaining fraction. That selection is a cut in the order of the md5 key, so the
decision for a document needs only its source's row. Running sums are taken over blocks of keys
first and then inside the one block of each source that holds the cut, so no task sees a whole source.

Edge cases: null text counts 0 words; a null source is a source of its own; a null doc_id has the key
of the empty string; rows with one doc_id in one source are taken together; a source without words
has target 0; an empty table gives an empty result. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, written

SEED = 17
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents aimed at for a block of keys; a source has at most 16**4 blocks.
BLOCK_DOCS = 512


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, words of the text, and the seeded key."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        draw("doc_id", seed).alias("key"),
    )


def draw(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def source_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, n_docs, target, whole repetitions, words still needed."""
    every = Window.partitionBy()
    # The windows below are over the source table only: one row per source.
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    level = (F.col("total") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    return (
        slim.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weight_all", F.sum("weight").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_room), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_room), F.lit(0)))
        .withColumn("level", level)
        # The level before the first source, in that order, that it doesn't fill.
        .withColumn("open", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank")))
        .withColumn("water", F.min_by("level", "open").over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double"))))
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("ratio"))
        .withColumn("need", (F.col("ratio") - F.col("whole")) * F.col("source_size"))
        .select("source", "source_size", "n_docs", "target", "whole", "need")
    )


def cuts(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the largest key of each source that gets the fractional repetition."""
    digits = F.least(F.lit(4), F.greatest(F.lit(0), F.ceil(F.log(F.col("n_docs") / BLOCK_DOCS) / F.log(F.lit(16.0))))).cast("int")
    plan = plan.withColumn("digits", digits)
    p = plan.select(F.col("source").alias("p_source"), "digits", "need")
    keyed = slim.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", F.substr("key", F.lit(1), F.col("digits")))
    in_source = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        keyed.groupBy("source", "block", "need")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
        .filter(F.col("before") < F.col("need"))
        .groupBy("source")
        .agg(F.max("block").alias("last_block"), F.max("before").alias("before"))
        .withColumnRenamed("source", "b_source")
    )
    inside = keyed.join(last, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("last_block")))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = (
        inside.withColumn("running", running)
        .groupBy("source")
        .agg(F.max(F.when(F.col("running") - F.col("size") / 2 <= F.col("need"), F.col("key"))).alias("last_key"), F.max("block").alias("last_block"))
        .select(F.col("source").alias("c_source"), F.coalesce("last_key", "last_block").alias("cut"))
    )
    return plan.join(found, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "whole", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim = cut(sized(docs, seed))
    return apply(slim, decide(slim, weights, max_epochs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target and taken; texts are not shuffled.
    Columns of docs with one of these names give way."""
    decided = decide(cut(sized(docs, seed)), weights, max_epochs)
    added = ("size", "source_size", "target", "taken")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("_cf_row"), "source", size.alias("size"), draw("doc_id", seed).alias("key"))
    return apply(rows, decided).filter("taken > 0").select(*(F.col("_cf_row")[c].alias(c) for c in docs.columns if c not in added), *added)


def decide(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source, written, so that joins with it are planned from its size."""
    plan = written(source_plan(slim, weights, max_epochs), "sources")
    return written(cuts(slim, plan), "cuts").withColumnRenamed("source", "s_source")


def apply(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows needs source, size and key; adds source_size, target and taken."""
    extra = F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return rows.join(decided, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("taken", (F.col("size") * (F.col("whole") + extra)).cast("long"))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM g),
r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::BIGINT AS weight_all,
         coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - cap_before) / (weight_all - weight_before) AS level FROM r),
u AS (SELECT *, (SELECT level FROM v WHERE cap > level * weight ORDER BY cap / weight, rank LIMIT 1) AS water FROM v),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(water * weight, cap::DOUBLE)) AS target FROM u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
q AS (SELECT *, floor(ratio)::BIGINT AS whole, (ratio - floor(ratio)) * source_size AS need FROM p),
o AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.whole, q.need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN running - size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
