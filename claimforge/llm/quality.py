"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns (at
most 3**rules rows, whatever the corpus) estimates the accuracies of each rule and the share of good
documents; a document stays if its posterior probability of being good reaches ``threshold``.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; an empty table
gives an empty result; repeated rows are judged alike. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
RULES = ("symbols", "symbol_runs", "lines", "repeats", "word_length", "stops")
THRESHOLD = 0.5
ROUNDS = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _near_equal(items: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """The items of a sorted array that equal a neighbour."""
    return F.filter(items, lambda x, k: F.coalesce(equal(x, F.get(items, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(items, k + 1)), F.lit(False)))


def with_repeated_words(df: DataFrame, w: str, name: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window found twice or more in the array w.

    Windows are sorted as longs: some bits of a hash over the position. Only windows whose hash bits
    meet another's are compared as text, so the count is exact and a long text costs a sort. The steps
    are columns of their own, so that the sort runs on primitive longs."""
    left = lambda x, n: F.call_function("shiftleft", x, n)
    bits = F.coalesce(F.ceil(F.log2(F.size(w) + 1)), F.lit(0)).cast("int")
    hashes = df.withColumns({"_cf_h": F.transform(w, lambda x: F.xxhash64(x)), "_cf_bits": bits})
    h, n = F.col("_cf_h"), F.col("_cf_bits")
    code = lambda x, i: left(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), n).bitwiseOR(i.cast("long"))
    coded = hashes.withColumns({"_cf_codes": F.sort_array(F.transform(h, code)), "_cf_mask": left(F.lit(1).cast("long"), n) - 1}).drop("_cf_h", "_cf_bits")
    mask, words = F.col("_cf_mask"), F.col(w)
    met = F.transform(_near_equal(F.col("_cf_codes"), lambda x, y: x.bitwiseXOR(y).between(F.lit(0), mask)), lambda x: x.bitwiseAND(mask).cast("int"))
    whole = F.filter(met, lambda i: i < F.size(words) - 2)  # the last two codes stand for no window
    windows = F.transform(whole, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("text"), i.alias("at")))
    equal = let(F.sort_array(windows), lambda s: F.transform(_near_equal(s, lambda x, y: x["text"] == y["text"]), lambda x: x["at"]))
    gaps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    count = let(F.sort_array(equal), lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda a, x: a + x))
    return coded.withColumn(name, count).drop("_cf_codes", "_cf_mask")


def signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, the counts of each text, and base_failed."""
    text = F.coalesce("text", F.lit(""))
    number = lambda chars: F.regexp_count(text, F.lit(chars)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    counted = docs.select(*keep, text.alias("_cf_text"), words(text).alias("_cf_w"), lines.alias("_cf_l"), (F.length(text) - number(r"[\x20\x09-\x0D]")).alias("word_chars"), number(f"[{SYMBOLS}]").alias("n_symbols"), number("[.!?]").alias("n_stops"), number(f"[{SYMBOLS}]+").alias("n_symbol_runs"))
    counted = with_repeated_words(counted, "_cf_w", "n_repeat_words")
    n_lines, distinct = F.size("_cf_l"), F.size(F.array_distinct("_cf_l"))
    counted = counted.select(
        *keep,
        F.size("_cf_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (n_lines - distinct).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        n_lines.cast("long").alias("n_lines"),
        "n_stops",
        "n_symbol_runs",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 to abstain, by rule. Rules that only show damage never vote good."""
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    density, runs = F.col("n_symbols") / chars, F.col("n_symbol_runs") / words
    repeats, lines = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean, stops, never = F.col("word_chars") / words, F.col("n_stops") / words, F.lit(False)
    return {
        "symbols": vote(density < 0.01, density > 0.05),
        "symbol_runs": vote(runs < 0.05, runs > 0.15),
        "lines": vote(never, (F.col("n_dup_lines") > 1) & (lines > 0.3)),
        "repeats": vote(never, repeats > 0.35),
        "word_length": vote(mean.between(3, 7), (mean < 2) | (mean > 14)),
        "stops": vote(stops.between(0.01, 0.4), (stops < 0.003) | (stops > 0.8)),
    }


#: The log odds of the share of good documents, and log P(vote | good) - log P(vote | bad) by rule and
#: vote; to abstain says nothing.
Model = tuple[float, dict[str, dict[int, float]]]


def fit(voted: DataFrame) -> Model:
    """Expectation-maximisation over the counts of vote patterns: for each rule the probability of each
    vote on good and on bad documents (its accuracies and how often it abstains), and the share of good
    documents. It starts from rules that are right in 4 of 5 votes; a good vote never comes to count
    as evidence of bad, nor a bad one of good."""
    patterns = [(tuple(r[k] for k in RULES), r["n"]) for r in voted.groupBy(*RULES).agg(F.count("*").alias("n")).collect()]  # at most 3**6 rows
    model: Model = (0.0, {k: {1: math.log(4), 0: 0.0, -1: -math.log(4)} for k in RULES})
    for _ in range(ROUNDS if patterns else 0):
        good = {k: {-1: 1.0, 0: 1.0, 1: 1.0} for k in RULES}
        bad = {k: {-1: 1.0, 0: 1.0, 1: 1.0} for k in RULES}
        n_good = n_bad = 1.0
        for pattern, n in patterns:
            p = _posterior(pattern, model)
            n_good, n_bad = n_good + n * p, n_bad + n * (1 - p)
            for k, v in zip(RULES, pattern, strict=True):
                good[k][v] += n * p
                bad[k][v] += n * (1 - p)
        ratio = {k: {v: math.log(good[k][v] / (n_good + 2)) - math.log(bad[k][v] / (n_bad + 2)) for v in (-1, 0, 1)} for k in RULES}
        model = (math.log(n_good / n_bad), {k: {1: max(0.0, r[1]), 0: 0.0, -1: min(0.0, r[-1])} for k, r in ratio.items()})
    return model


def _posterior(pattern: tuple[int, ...], model: Model) -> float:
    odds = model[0] + sum(model[1][k][v] for k, v in zip(RULES, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior(model: Model, by: dict[str, Column]) -> Column:
    odds = F.lit(model[0])
    for k in RULES:
        r = model[1][k]
        odds = odds + F.when(by[k] > 0, r[1]).when(by[k] < 0, r[-1]).otherwise(r[0])
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, keep: list[str], threshold: float) -> DataFrame:
    """The columns in keep, the counts, base_failed, quality (the posterior) and kept.

    The counts are cut off first: the planner would repeat their expressions in what uses them."""
    counted = cut(signals(docs, keep))
    p = posterior(fit(counted.select(*(v.alias(k) for k, v in votes().items()))), votes())
    return counted.withColumns({"quality": p, "kept": ~F.col("base_failed") & (p >= threshold)})


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the posterior (six digits) of every document."""
    return judged(docs, ["doc_id"], threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def kept(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs that judge() keeps; rows equal in doc_id and text are judged alike."""
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("_cf_hash"))
    gone = judged(named, ["doc_id", "_cf_hash"], threshold).filter("not kept").select(F.col("doc_id").alias("_cf_id"), "_cf_hash").distinct()
    # Always a merge join: the plan, and so its disk, is the same at every size.
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_cf_id")) & (F.xxhash64("text") == F.col("_cf_hash")), "left_anti")


def _oracle() -> str:
    """The same in DuckDB: votes from the counts, and the rounds as a recursive table of the model over the vote patterns."""
    i = range(1, len(RULES) + 1)
    odds = "s + " + " + ".join(f"CASE v{k} WHEN 1 THEN a{k} WHEN -1 THEN c{k} ELSE 0 END" for k in i)
    ratio = lambda k, v: f"ln((1 + coalesce(sum(n * q) FILTER (v{k} = {v}), 0)) / (3 + sum(n * q))) - ln((1 + coalesce(sum(n * (1 - q)) FILTER (v{k} = {v}), 0)) / (3 + sum(n * (1 - q))))"
    step = ", ".join(f"greatest(0, {ratio(k, 1)}) AS a{k}, least(0, {ratio(k, -1)}) AS c{k}" for k in i)
    start = ", ".join(f"ln(4.0::DOUBLE) AS a{k}, -ln(4.0::DOUBLE) AS c{k}" for k in i)
    columns = ", ".join(f"a{k}, c{k}" for k in i)
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09\x0B-\x0D]')) AS l FROM documents),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rw AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(x, '[.!?]')) AS n_stops, len(regexp_extract_all(x, '[#*$%&|<>]+')) AS n_runs FROM t LEFT JOIN rw USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS density, n_runs / greatest(n_words, 1) AS runs, n_dup_lines / greatest(n_lines, 1) AS lines, n_repeat_words / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS mean, n_stops / greatest(n_words, 1) AS stops FROM c),
v AS (SELECT *, CASE WHEN density > 0.05 THEN -1 WHEN density < 0.01 THEN 1 ELSE 0 END AS v1, CASE WHEN runs > 0.15 THEN -1 WHEN runs < 0.05 THEN 1 ELSE 0 END AS v2, CASE WHEN n_dup_lines > 1 AND lines > 0.3 THEN -1 ELSE 0 END AS v3, CASE WHEN repeats > 0.35 THEN -1 ELSE 0 END AS v4,
      CASE WHEN mean < 2 OR mean > 14 THEN -1 WHEN mean BETWEEN 3 AND 7 THEN 1 ELSE 0 END AS v5, CASE WHEN stops < 0.003 OR stops > 0.8 THEN -1 WHEN stops BETWEEN 0.01 AND 0.4 THEN 1 ELSE 0 END AS v6 FROM f),
p AS (SELECT v1, v2, v3, v4, v5, v6, count(*) AS n FROM v GROUP BY ALL),
m AS (SELECT 0 AS k, 0.0::DOUBLE AS s, {start} UNION ALL
      SELECT k + 1, ln((1 + sum(n * q)) / (1 + sum(n * (1 - q)))), {step} FROM (SELECT k, p.*, 1 / (1 + exp(-({odds}))) AS q FROM m, p WHERE k < {ROUNDS}) GROUP BY k),
z AS (SELECT s, {columns} FROM m WHERE k = {ROUNDS}),
y AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS posterior FROM v, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {THRESHOLD} AS kept, round(posterior, 6) AS quality FROM y
"""


ORACLE = _oracle()
