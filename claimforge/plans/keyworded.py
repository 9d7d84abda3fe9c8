"""Queries on the keyword plan: orders as patents of all variants, their lines as claims, replies in four arms by key and line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywording
from .tabular import t

QUERIES, ORACLES = {}, {}

COMBINED = (
    '[{"keyword_text": "杯#(a)", "keyword_type": "invention_based", "combination_pattern": "p", "confidence": 0.7}, {"keyword_text": " 杯#A", "confidence": 0.9}, {"keyword_text": "杯#a", "confidence": 0.95}, {"keyword_text": "ab"}, {"keyword_text": "x/y#"}]',
    "1. 保温#\nabc\nab",
    "[杯#\nab]",
    '[{"keyword_text": "保温#", "keyword_type": "holder_based"}]',
)

#: Tasks by the rules of each variant (v: 0 general, 1 home_appliances, 2 fitness), and the keywords that are written.
TASKS = """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS seq, CASE WHEN l_orderkey % 11 = 0 THEN ' ' ELSE (l_linenumber + l_orderkey % 2)::VARCHAR END AS cid, min(l_returnflag) = 'R' AS own FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT o_orderkey AS id, o_orderkey % 3 AS v, o_orderpriority AS pri, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '科技同款' || CASE WHEN o_orderkey % 5 > 0 THEN '壶' ELSE '杯' END END AS holder FROM orders),
g AS (SELECT r.*, seq, cid FROM r LEFT JOIN c ON c.id = r.id WHERE v = 0 QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN cid = '1' THEN 0 WHEN own THEN 1 ELSE 2 END, seq) = 1),
o AS (SELECT r.*, seq, cid FROM r JOIN c ON c.id = r.id WHERE v > 0 QUALIFY own OR (NOT bool_or(own) OVER (PARTITION BY r.id) AND seq = min(seq) OVER (PARTITION BY r.id))),
t AS (SELECT *, (id + coalesce(seq, 0)) % 4 AS arm, CASE WHEN seq IS NULL THEN 'P' || id WHEN cid = ' ' AND v = 1 THEN 'RECORD-' || row_number() OVER (PARTITION BY id ORDER BY seq) ELSE cid END AS claim_id,
CASE v WHEN 0 THEN id % 5 > 0 OR (seq IS NOT NULL AND id % 7 > 0) WHEN 1 THEN id % 7 > 0 ELSE id % 7 > 0 AND cid <> ' ' END AS valid FROM (FROM g UNION ALL FROM o)),
w(arm, general, place, x, kind, pattern, sure) AS (VALUES (0, true, 0, '杯#A', 'COMBINED', '', 0.9), (1, true, 0, '1. 保温#', 'COMBINED', 'text_extraction', 0.6), (1, true, 1, 'abc', 'COMBINED', 'text_extraction', 0.6), (2, true, 0, '[杯#', 'COMBINED', 'text_extraction', 0.6), (2, true, 1, 'ab]', 'COMBINED', 'text_extraction', 0.6), (3, true, 0, '保温#', 'HOLDER_BASED', '', 0.8),
(0, false, 0, '杯#(a)', 'INVENTION_BASED', 'p', 0.7), (0, false, 1, '杯#A', 'COMBINED', '', 0.9), (0, false, 2, '杯#a', 'COMBINED', '', 0.95), (0, false, 3, 'ab', 'COMBINED', '', 0.8), (0, false, 4, 'x/y#', 'COMBINED', '', 0.8), (2, false, 0, '[杯#', 'COMBINED', 'text_extraction', 0.6)),
s AS (SELECT id, v, claim_id, place + CASE WHEN v = 0 AND holder IS NOT NULL THEN 1 ELSE 0 END AS place, replace(x, '#', pri) AS keyword_text, kind AS keyword_type, pattern AS source_location, sure::DOUBLE AS confidence_score FROM t JOIN w ON w.arm = t.arm AND w.general = (v = 0) WHERE valid
UNION ALL SELECT id, v, claim_id, 0, holder, 'HOLDER_BASED', '品牌同款型-补充生成', 0.88 FROM t WHERE valid AND v = 0 AND holder IS NOT NULL)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def plan(spark, d) -> keywording.Keywording:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    lines = t(spark, d, "lineitem").groupBy(key, line).agg(F.min("l_returnflag").alias("flag"))
    claims = lines.select(key.alias("record_id"), line.alias("seq"), F.when(key % 11 == 0, " ").otherwise((line + key % 2).cast("string")).alias("claim_id"), F.when(F.col("flag") == "R", "INDEPENDENT").otherwise("DEPENDENT").alias("claim_type"), F.when(key % 7 > 0, F.concat(F.lit("claim "), line.cast("string"))).otherwise(" ").alias("claim_text"))
    i = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    orders = t(spark, d, "orders")
    records = orders.select(i.alias("record_id"), F.get(F.array(*map(F.lit, ("general", "home_appliances", "fitness"))), (i % 3).cast("int")).alias("variant"), F.concat(F.lit("P"), i.cast("string")).alias("patent_number"), F.when(i % 2 == 0, F.concat("o_orderstatus", F.lit("科技有限公司"))).otherwise("张三").alias("patent_holder"), F.when(i % 5 > 0, F.concat(F.lit("壶 "), "o_orderpriority")).alias("technical_field"), none.alias("background_tech"), F.lit(" ").alias("invention_content"))
    of = orders.select(i.alias("record_id"), "o_orderpriority").join(lines.select(key.alias("l_key"), line.alias("seq")), F.col("record_id") == F.col("l_key"), "left")
    arm = (F.col("record_id") + F.coalesce("seq", F.lit(0))) % 4
    combined = F.replace(F.get(F.array(*map(F.lit, COMBINED)), arm.cast("int")), F.lit("#"), F.col("o_orderpriority"))
    said = {"product_objects": F.lit('{"primary_product_object": "杯", "search_product_objects": ["壶", "锅"]}'), "extraction": F.lit("1. 保温\n2. 防滑"), "filtering": F.when(arm == 3, "{}").otherwise('{"filtered_core_terms": [{"text": "保温"}]}'), "combination": combined}
    # The first attempt of each stage is a broken one.
    tries = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(n).alias("attempt"), (x if n else F.lit("[broken")).alias("reply")) for s, x in said.items() for n in (0, 1))))
    replies = of.select("record_id", "seq", tries.alias("r")).select("record_id", "seq", "r.*")
    return keywording.keyworded(records, claims, replies)


@query(TASKS + "SELECT id AS record_id, claim_id, place::INT AS place, keyword_text, keyword_type, source_location, confidence_score FROM s")
def q_keyword_plan(spark, d):
    """Variant matrix: claims, validity, grounding, term filters, holder keyword, guardrails and merging by variant; keywords as written."""
    return plan(spark, d).stored.select("record_id", "claim_id", "place", "keyword_text", "keyword_type", "source_location", "confidence_score")


@query(TASKS + """SELECT id AS record_id, ['general', 'home_appliances', 'fitness_equipment'][v + 1] AS workflow_variant, coalesce(n, 0) AS keywords_count, CASE WHEN bool_or(valid AND (v <> 1 OR arm % 2 = 0)) THEN '' ELSE 'NO_KEYWORDS_TO_WRITE' END AS exception_type
FROM t LEFT JOIN (SELECT id AS s_id, count(*) AS n FROM s GROUP BY id) ON s_id = id GROUP BY id, v, n""")
def q_keyword_runs(spark, d):
    """Runs of the plan: tag, count, and what is said if there is nothing to write."""
    return plan(spark, d).runs.drop("exception_message")


@query(TASKS + """SELECT v, keyword_type, count(*) AS n FROM (SELECT v, keyword_type FROM s WHERE v > 0 UNION ALL SELECT 2, 'EMPTY' FROM t WHERE v = 2 AND valid AND arm % 2 = 1) GROUP BY v, keyword_type""")
def q_keyword_empty(spark, d):
    """Rows by type; fitness has a row for a claim without keywords, home_appliances has none."""
    rows = plan(spark, d).assembled.filter("variant <> 'general'")
    return rows.groupBy(F.when(F.col("variant") == "fitness", 2).otherwise(1).alias("v"), "keyword_type").agg(F.count("*").alias("n"))
