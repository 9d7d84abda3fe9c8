"""URL filters: host and path rules, and a character language-model ratio for the rest.

The longest rule that fits a URL decides. URLs under allow rules train one character model, URLs under
block rules another: variable-order Markov models (contexts of 0 to ORDER characters, each smoothed
with the next shorter one). A URL without a rule is allowed if its log-likelihood difference per
character reaches a threshold, calibrated for balanced accuracy on a fifth of the ruled URLs with models
of the other four fifths; the scores are those of models of all ruled URLs.

Counts are exact: a gram is its ORDER + 1 bytes in one number, which is unique, and the grams of a lower
order are its last bytes. What a character adds to a score depends on its gram only, so it is worked out
by joins once a distinct gram, and then joined to the grams of each distinct URL.

Edge cases: a null url or one without :// has empty host and path, fits no rule and is judged as the
empty text; if a class has no URLs the threshold is 0 and all scores are 0 (allow); if only the four fifths lack one,
the threshold is 0; equal URLs get
equal verdicts; an empty table gives an empty result. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
ORDER, SMOOTH = 4, 2.0
#: Fixed point of what a gram adds, so that sums don't depend on their order.
POINT = 2.0**36
#: Counts of block and allow URLs, without the calibration fifth and of all.
COUNTS = ("block_fit", "allow_fit", "block_all", "allow_all")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, said (the rule's verdict) of every page."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = said = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        said = F.when(fits, verdict) if said is None else said.when(fits, verdict)
    return split.withColumns({"rule": rule, "said": said})


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams of each text and how often; before a text stand zero bytes, after it one byte 1."""
    pad = bytes(ORDER)
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            coded = [t.encode() for t in part.column("text").to_pylist()]
            data = np.frombuffer(b"".join(pad + t + b"\1" for t in coded), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(coded)), [len(t) + 1 for t in coded])
            at = np.arange(len(row)) + (row + 1) * ORDER
            gram = sum(data[at - k] << 8 * k for k in range(ORDER + 1))
            pair, times = np.unique((row << 8 * (ORDER + 1)) + gram, return_counts=True)
            owner = pa.array(pair >> 8 * (ORDER + 1))
            yield pa.RecordBatch.from_arrays([*(part.column(n).take(owner) for n in ("row", "said", "fit", "n")), pa.array(pair & (1 << 8 * (ORDER + 1)) - 1), pa.array(times.astype(np.int64))], ["row", "said", "fit", "n", "gram", "times"])


def _last(gram: Column, size: int) -> Column:
    """Its last size bytes."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def counted(grams: DataFrame) -> DataFrame:
    """gram and COUNTS of the ruled URLs."""
    n = F.col("n") * F.col("times")
    of = {f"{v}_{w}": F.sum(F.when((F.col("said") == v) & (F.col("fit") | F.lit(w == "all")), n).otherwise(0)) for w in ("fit", "all") for v in ("block", "allow")}
    return written(grams.filter("said is not null").groupBy("gram").agg(*(of[c].alias(c) for c in COUNTS)), "grams")


def added(needed: DataFrame, counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """What every needed gram adds to the log-likelihood difference, by the two pairs of models (fit, all)."""
    found = needed.select("gram", *(F.lit(1 / 256).alias(f"p_{c}") for c in COUNTS))
    for k in range(ORDER + 1):
        for kind, size, key in (("context", k, lambda g, k=k: _last(F.shiftright(g, 8), k)), ("own", k + 1, lambda g, k=k: _last(g, k + 1))):
            if not size:
                found = found.withColumns({f"{kind}_{c}": F.lit(totals[c]) for c in COUNTS})
                continue
            table = counts.groupBy(key(F.col("gram")).alias("key")).agg(*(F.sum(c).alias(f"{kind}_{c}") for c in COUNTS))
            # One or two bytes: at most 2**16 rows.
            found = found.withColumn("place", key(F.col("gram"))).join(F.broadcast(table) if size <= 2 else table, F.col("place") == F.col("key"), "left").drop("place", "key")
        p = {c: (F.coalesce(f"own_{c}", F.lit(0)) + SMOOTH * F.col(f"p_{c}")) / (F.coalesce(f"context_{c}", F.lit(0)) + SMOOTH) for c in COUNTS}
        found = found.select("gram", *(v.alias(f"p_{c}") for c, v in p.items()))
    fixed = lambda w: F.round(F.log(F.col(f"p_allow_{w}") / F.col(f"p_block_{w}")) * POINT).cast("long").alias(w)
    return written(found.select("gram", fixed("fit"), fixed("all")), "added")


def scored(texts: DataFrame) -> tuple[DataFrame, bool]:
    """host, path, said, fit, n, fit_ratio, ratio of every distinct URL; and whether the fit models have both classes."""
    grams = texts.select("row", "said", "fit", "n", F.concat("host", "path").alias("text")).mapInArrow(_grams, "row long, said string, fit boolean, n long, gram long, times long")
    counts = counted(grams)
    totals = {c: v or 0 for c, v in counts.agg(*(F.sum(c).alias(c) for c in COUNTS)).first().asDict().items()}
    values = added(grams.select("gram").distinct(), counts, totals)
    total = lambda w: F.sum((F.col("times") * F.col(w)).cast("decimal(20,0)")).cast("double") / POINT
    sums = grams.select("row", "gram", "times").join(values, "gram").groupBy("row").agg(total("fit").alias("fit_sum"), total("all").alias("all_sum"))
    length = F.octet_length(F.concat("host", "path")) + 1
    both = {w: totals[f"block_{w}"] > 0 and totals[f"allow_{w}"] > 0 for w in ("fit", "all")}
    ratio = lambda w: (F.col(f"{w}_sum") / length if both[w] else F.lit(0.0))
    return cut(texts.join(sums, "row").select("host", "path", "said", "fit", "n", ratio("fit").alias("fit_ratio"), ratio("all").alias("ratio"))), both["fit"]


def threshold(scored: DataFrame) -> float:
    """The ratio with the best balanced accuracy on (said, ratio, n); from counts in bins of 0.01."""
    bins = scored.groupBy("said", F.round(F.greatest(F.least("ratio", F.lit(20.0)), F.lit(-20.0)) * 100).cast("int").alias("bin")).agg(F.sum("n").alias("count")).collect()  # at most 2 * 4001 rows
    n = {v: sum(r["count"] for r in bins if r["said"] == v) for v in ("allow", "block")}
    if not n["allow"] or not n["block"]:
        return 0.0
    edges = sorted({r["bin"] for r in bins} | {0})
    right = lambda e: sum(r["count"] / n[r["said"]] for r in bins if (r["bin"] >= e) == (r["said"] == "allow"))
    return max(edges, key=lambda e: (round(right(e), 9), -abs(e))) / 100 - 0.005


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page."""
    rows = cut(ruled(pages, rules))
    fit = F.crc32(F.concat("host", "path").cast("binary")) % 5 != 0
    texts = rows.groupBy("host", "path").agg(F.first("said").alias("said"), F.count("*").alias("n")).withColumns({"fit": fit, "row": F.monotonically_increasing_id()})
    found, both = scored(cut(texts))
    least = threshold(found.filter("said is not null and not fit").select("said", "n", F.col("fit_ratio").alias("ratio"))) if both else 0.0
    verdict = F.coalesce("said", F.when(F.col("ratio") >= least, "allow").otherwise("block"))
    return rows.join(found.select("host", "path", "ratio"), ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")


def _oracle() -> str:
    """The same in DuckDB: bytes as hexadecimal digits, counts of each order by joins, and the best edge of the bins."""
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, order, strict=True))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, order, strict=True))
    sums = ", ".join(f"coalesce(sum(n * times) FILTER (said = '{v}'{' AND fit' * (w == 'fit')}), 0)::DOUBLE AS {v}_{w}" for w in ("fit", "all") for v in ("block", "allow"))
    joins, steps, before = [], [], "u"
    for k in range(ORDER + 1):
        own, context = f"substr(g, {9 - 2 * k})", f"substr(g, {9 - 2 * k}, {2 * k})"
        joins.append(f"o{k} AS (SELECT {own} AS key, {sums} FROM g WHERE said IS NOT NULL GROUP BY 1), x{k} AS (SELECT {context} AS key, {sums} FROM g WHERE said IS NOT NULL GROUP BY 1)")
        after = ", ".join(f"(coalesce(o{k}.{c}, 0) + {SMOOTH} * p_{c}) / (coalesce(x{k}.{c}, 0) + {SMOOTH}) AS p_{c}" for c in COUNTS)
        steps.append(f"s{k} AS (SELECT g, {after} FROM {before} LEFT JOIN o{k} ON o{k}.key = {own} LEFT JOIN x{k} ON x{k}.key = {context})")
        before = f"s{k}"
    added = ", ".join(f"round(ln(p_allow_{w} / p_block_{w}) * {POINT})::BIGINT AS sum_{w}" for w in ("fit", "all"))
    total = lambda w: f"(CASE WHEN has_{w} THEN sum(times * a.sum_{w})::DOUBLE / {POINT} / any_value(len + 1) ELSE 0.0::DOUBLE END)"
    return rf"""
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM w),
d AS (SELECT host, path, any_value(said) AS said, count(*) AS n, hex(encode(host || path)) AS h FROM r GROUP BY host, path),
e AS (SELECT *, len(h) // 2 AS len, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 5 <> 0 AS fit FROM d, t),
g AS (SELECT host, path, said, fit, n, len, g, count(*) AS times FROM (SELECT *, substr('{"00" * ORDER}' || h || '01', 2 * unnest(range(len + 1)) + 1, {2 * ORDER + 2}) AS g FROM e) GROUP BY ALL),
z AS (SELECT count(*) FILTER (said = 'block' AND fit) > 0 AND count(*) FILTER (said = 'allow' AND fit) > 0 AS has_fit, count(*) FILTER (said = 'block') > 0 AND count(*) FILTER (said = 'allow') > 0 AS has_all FROM e),
u AS (SELECT DISTINCT g, {", ".join(f"1 / 256 AS p_{c}" for c in COUNTS)} FROM g),
{", ".join(joins)},
{", ".join(steps)},
a AS (SELECT g, {added} FROM {before}),
q AS (SELECT host, path, any_value(g.said) AS said, any_value(g.fit) AS fit, any_value(n) AS n, {total("fit")} AS fit_ratio, {total("all")} AS ratio FROM g JOIN a USING (g), z GROUP BY host, path, has_fit, has_all),
b AS (SELECT said, round(greatest(least(fit_ratio, 20), -20) * 100)::INT AS bin, sum(n) AS c FROM q WHERE said IS NOT NULL AND NOT fit GROUP BY ALL),
y AS (SELECT sum(c) FILTER (said = 'allow') AS allowed, sum(c) FILTER (said = 'block') AS blocked FROM b),
k AS (SELECT edge, round(sum(CASE WHEN (bin >= edge) = (said = 'allow') THEN c / CASE said WHEN 'allow' THEN allowed ELSE blocked END ELSE 0 END), 9) AS score FROM (SELECT DISTINCT bin AS edge FROM b UNION SELECT 0), b, y GROUP BY edge),
m AS (SELECT CASE WHEN has_fit AND allowed > 0 AND blocked > 0 THEN (SELECT edge FROM k ORDER BY score DESC, abs(edge), edge LIMIT 1) / 100 - 0.005::DOUBLE ELSE 0.0::DOUBLE END AS least FROM y, z)
SELECT page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN ratio >= least THEN 'allow' ELSE 'block' END) AS verdict, ratio FROM r JOIN q ON q.host = r.host AND q.path = r.path, m
"""


ORACLE = _oracle()
