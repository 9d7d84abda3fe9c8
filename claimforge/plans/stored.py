"""Queries on paged tables, versioned stores, polls and live tasks. The SQL beside each says the same for DuckDB."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..operators import polling
from ..sources import charsets, keyed, paged, versions
from ..sources.shared import shared_path
from .tabular import t

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT 'part' AS table_name, p_partkey AS id, p_name AS name, NULL::VARCHAR AS error FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier
UNION ALL SELECT 'nation', NULL, NULL, 'JSONDecodeError' FROM (SELECT count(*) FROM nation) UNION ALL SELECT 'missing', NULL, NULL, 'FileNotFoundError'""")
def q_paged_scan(spark, d):
    """Parts and suppliers as paged tables; a table with a broken page and a missing one give errors only."""
    root = shared_path(spark, "tables")
    for name, key, label in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        paged.store_lines(t(spark, d, name).select(F.col(key).alias("id"), F.col(label).alias("name")), root, name)
    line = F.when(F.col("n_nationkey") == 7, "{").otherwise(F.to_json(F.struct(F.struct("n_name").alias("fields"))))
    t(spark, d, "nation").select(line.alias("value")).write.text(f"{root}/nation")
    records, errors = paged.scan(spark, root, ["part", "supplier", "nation", "missing"])
    v = F.parse_json("record_json")
    rows = records.select("table_name", F.try_variant_get(v, "$.id", "long").alias("id"), F.try_variant_get(v, "$.name", "string").alias("name"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(errors.select("table_name", F.regexp_extract("error", r"^\w+", 0).alias("error")), allowMissingColumns=True)


def _lines(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("l_partkey"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_partkey END::BIGINT AS l_partkey FROM lineitem WHERE CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber % 2 = 0 ELSE l_orderkey % 5 <> 0 END""")
def q_replaced_children(spark, d):
    """K1, K4: lines as children of orders. Every third order gets new ones (some none), every fifth loses its own, others keep theirs."""
    root, rows = shared_path(spark, "store"), _lines(spark, d)
    versions.commit(spark, root, {"lines": versions.Change(rows, rows.select("l_orderkey"), "l_orderkey")})
    new = rows.filter("l_orderkey % 3 = 0 and l_linenumber % 2 = 0").withColumn("l_partkey", F.lit(-1).cast("long"))
    keys = rows.filter("l_orderkey % 3 = 0 or l_orderkey % 5 = 0").select("l_orderkey")
    for _ in range(2):  # the second time it is a batch that has been applied
        versions.commit(spark, root, {"lines": versions.Change(new, keys, "l_orderkey")}, writer="q", batch=1)
    return versions.read(spark, root, "lines")


@query("""WITH s AS (SELECT o_orderkey AS id, 'run-' || o_orderkey AS run_id FROM orders WHERE o_orderstatus <> 'F'),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END AS cid, CASE o_orderkey % 3 WHEN 1 THEN 'run-' || o_orderkey WHEN 2 THEN 'new-' || o_orderkey ELSE '' END AS run_id FROM orders)
SELECT o_orderkey, coalesce(a.id, b.id, ('0x' || substr(md5(n.run_id), 1, 15))::BIGINT) AS id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'run_id' ELSE 'inserted' END AS found_by FROM n LEFT JOIN s a ON a.id = n.cid AND n.cid > 0 LEFT JOIN s b ON b.run_id = n.run_id AND b.run_id <> ''""")
def q_resolved_runs(spark, d):
    """K4: runs found by id, else by run_id, else inserted."""
    orders, key = t(spark, d, "orders"), F.col("o_orderkey")
    text = key.cast("string")
    stored = orders.filter("o_orderstatus <> 'F'").select(key.cast("long").alias("id"), F.concat(F.lit("run-"), text).alias("run_id"))
    new = orders.select(key, F.when(key % 3 == 0, key).otherwise(0).cast("long").alias("claim_compare_run_id"), F.when(key % 3 == 1, F.concat(F.lit("run-"), text)).when(key % 3 == 2, F.concat(F.lit("new-"), text)).otherwise("").alias("run_id"))
    return versions.resolved_runs(stored, new).select("o_orderkey", "id", "found_by")


@query("""WITH p AS (SELECT event_id, event_id // 40 AS run_id, CASE WHEN event_id // 40 % 2 = 0 THEN event_id // 13 ELSE event_id // 6 END % 2 = 0 AS ok, CASE WHEN event_id % 97 = 0 THEN 'completed' ELSE event_type END AS status, user_id % 3 AS run FROM events),
s AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'timeout' WHEN 'O' THEN 'running' ELSE '' END AS stored FROM orders),
a AS (SELECT p.*, stored, sum(ok::INT) OVER (PARTITION BY p.run_id ORDER BY event_id) AS island, last_value(CASE WHEN ok THEN status || run END IGNORE NULLS) OVER (PARTITION BY p.run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p LEFT JOIN s ON s.run_id = p.run_id),
b AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY run_id, island ORDER BY event_id) AS failures FROM a),
c AS (SELECT *, NOT ok AND failures >= 5 AND coalesce(stored, '') <> '' AS rd, CASE WHEN ok THEN status IN ('completed', 'error', 'cancelled', 'timeout') ELSE failures >= 12 OR (failures >= 5 AND coalesce(stored, '') = 'timeout') END AS ends FROM b),
e AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM c)
SELECT run_id, event_id, 'observed' AS action, status FROM e WHERE NOT gone AND ok AND (last IS NULL OR last <> status || run)
UNION ALL SELECT run_id, event_id, 'stored', stored FROM e WHERE NOT gone AND rd
UNION ALL SELECT run_id, event_id, 'failed', 'error' FROM e WHERE NOT gone AND NOT ok AND failures >= 12 AND NOT (rd AND stored = 'timeout')""")
def q_poll_ladder(spark, d):
    """40 events as the polls of a run, failing for 6 or 13 in a row; orders as stored runs."""
    i = F.col("event_id")
    run = F.floor(i / 40)
    ok = F.when(run % 2 == 0, F.floor(i / 13)).otherwise(F.floor(i / 6)) % 2 == 0
    polls = t(spark, d, "events").select(run.cast("long").alias("run_id"), "event_id", ok.alias("ok"), F.when(i % 97 == 0, "completed").otherwise(F.col("event_type")).alias("status"), (F.col("user_id") % 3).alias("run"))
    kind = F.col("o_orderstatus")
    stored = t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("run_id"), F.when(kind == "F", "timeout").when(kind == "O", "running").otherwise("").alias("status"))
    return polling.persisted(polls, stored, order=("event_id",), reported=("status", "run"))


@query("""WITH x AS (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END AS st FROM events),
y AS (SELECT event_id, event_type, ts, last_value(st IGNORE NULLS) OVER w AS st, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS beat FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN beat >= ts - INTERVAL 12 HOURS AND st = 'queued' THEN 'running' ELSE st END AS status, coalesce(st IN ('completed', 'error'), false) AS is_finished FROM y WHERE event_type = 'click'""")
def q_live_status(spark, d):
    """Clicks read a user's run, whose status other events store and views keep alive."""
    kind, rows = F.col("event_type"), t(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "completed").when(kind == "error", "error")
    found = polling.live_status(rows.filter(kind == "click"), rows.withColumn("status", status).filter("status is not null"), rows.filter(kind == "view"), "12 HOURS", order=("ts", "event_id"))
    return found.select("event_id", "status", "is_finished")


@F.pandas_udf(BinaryType())
def _encoded(texts: pd.Series, charsets: pd.Series) -> pd.Series:
    return pd.Series([t.encode(c) for t, c in zip(texts, charsets, strict=True)], dtype=object)


_HEADS = ("utf-8", ""), ("utf-16-le", ""), ("utf-16-be", ""), ("gb18030", "权利要求书与检索结果的说明。"), ("big5", "權利要求書與檢索結果的說明。"), ("shift_jis", "検索結果と請求項の説明です。"), ("gb18030", "")


@query("""WITH x AS (SELECT page_id, page_id % 8 AS arm, CASE page_id % 8 WHEN 3 THEN '权利要求书与检索结果的说明。' WHEN 4 THEN '權利要求書與檢索結果的說明。' WHEN 5 THEN '検索結果と請求項の説明です。' ELSE '' END || CASE WHEN page_id % 8 IN (4, 5) THEN regexp_replace(html, '[^\x00-\x7f]', '', 'g') ELSE html END AS html FROM pages)
SELECT page_id, CASE WHEN arm < 7 THEN md5(html) END AS digest, CASE WHEN arm IN (3, 6) THEN CASE WHEN arm = 3 OR regexp_matches(html, '[^\x00-\x7f]') THEN 'gb18030' ELSE 'utf-8' END WHEN arm < 7 THEN (['utf-8', 'utf-16-le', 'utf-16-be', '', 'big5', 'shift_jis'])[arm + 1] END AS charset, CASE WHEN arm = 7 THEN 'CHARSET_UNDECIDED' END AS error FROM x""")
def q_charsets(spark, d):
    """Pages in seven encodings, one in eight not a text in any."""
    arm, ascii_only = F.col("page_id") % 8, F.regexp_replace("html", r"[^\x00-\x7f]", "")
    at = lambda k: F.get(F.array(*(F.lit(h[k]) for h in _HEADS)), F.least(arm, F.lit(6)).cast("int"))
    text = F.concat(at(1), F.when(arm.isin(4, 5), ascii_only).otherwise(F.col("html")))
    content = F.when(arm == 7, F.unhex(F.lit("FF81FF00FD"))).otherwise(_encoded(text, at(0)))
    found = t(spark, d, "pages").select("page_id", charsets.charset_text(content).alias("f"))
    return found.select("page_id", F.md5(F.col("f.text").cast("binary")).alias("digest"), "f.charset", "f.error")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, l_linenumber AS claim FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (1, 7, 32, 33)")
def q_keyed_lookup(spark, d):
    """Orders as records and lines as their claims, in buckets by record; a few records with their claims."""
    mark = uuid.uuid4().hex
    orders = t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"))
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").alias("claim"))
    for name, df in ((f"records_{mark}", orders), (f"claims_{mark}", lines)):
        keyed.store(df, name, "id", shared_path(spark, name), 8)
    return keyed.with_children(spark, f"records_{mark}", f"claims_{mark}", "id", [1, 7, 32, 33])
