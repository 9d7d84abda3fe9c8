"""Queries on texts. Patent texts are put together from the driver tables by rule, so that SQL knows
what must come out again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keywords, patent, replies, rules, text
from ..operators import dedup
from ..sources import files
from .tabular import t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) < 100 THEN 'EMPTY_OR_CORRUPT_FILE' END AS error FROM documents")
def q_text_gate(spark, d):
    """S5."""
    return t(spark, d, "documents").select("doc_id", files.text_gate(F.col("text")).alias("error"))


@query("""WITH x AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'en')) AS f, len(regexp_extract_all(lower(text), 'que')) + len(regexp_extract_all(lower(text), 'er')) AS a FROM documents)
SELECT doc_id, CASE WHEN f = 0 AND a = 0 THEN 'general' WHEN f >= a THEN 'fitness_equipment' ELSE 'home_appliances' END AS industry, CASE WHEN f = 0 AND a = 0 THEN 0.4 ELSE round(greatest(f, a) / (f + a), 2) END AS confidence FROM x""")
def q_industry_route(spark, d):
    """A17, with terms of this corpus."""
    return t(spark, d, "documents").select("doc_id", rules.industry(F.col("text"), ("the", "en"), ("que", "er")).alias("r")).select("doc_id", "r.industry", "r.confidence")


def patents(spark, d) -> DataFrame:
    """Conversations as patents: every turn is a numbered claim, assistant turns depend on the claim before."""
    flat = F.regexp_replace("text", r"(?U:\s)+", " ")
    head = F.concat((F.col("turn") + 1).cast("string"), F.lit("."), F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.concat(F.lit(" 根据权利要求"), F.col("turn").cast("string"), F.lit("所述的装置，"))).otherwise(" "))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(head, flat).alias("c")))), lambda x: x["c"]), "\n")
    return t(spark, d, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(body.alias("claims_text"))


@query("""SELECT conv_id AS task_id, (turn + 1)::VARCHAR AS claim_id, CASE WHEN role = 'assistant' AND turn > 0 THEN 'DEPENDENT' ELSE 'INDEPENDENT' END AS claim_type, CASE WHEN role = 'assistant' AND turn > 0 THEN turn::VARCHAR END AS parent_claim_id,
trim(CASE WHEN role = 'assistant' AND turn > 0 THEN '根据权利要求' || turn || '所述的装置，' ELSE '' END || regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS claim_text FROM conversations""")
def q_claims(spark, d):
    """Claims put into one text and parsed again."""
    return patent.claims(patents(spark, d)).select("task_id", "claim_id", "claim_type", "parent_claim_id", "claim_text")


@query("""WITH x AS (SELECT conv_id, turn, unnest(string_split(replace(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), '.', '。'), '。')) AS u FROM conversations)
SELECT conv_id, turn, count(*) FILTER (trim(u) <> '') AS n_units, sum(length(trim(u)))::BIGINT AS n_chars FROM x GROUP BY ALL HAVING n_units > 0""")
def q_sentence_units(spark, d):
    """X8, with full stops as 。."""
    flat = F.replace(F.regexp_replace("text", r"(?U:\s)+", " "), F.lit("."), F.lit("。"))
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.filter(patent.sentence_units(flat), lambda x: x != "").alias("u")).filter(F.size("u") > 0)
    chars = F.aggregate(F.transform("u", lambda x: F.length(text.strip(F.replace(x, F.lit("。"), F.lit(""))))), F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.size("u").cast("long").alias("n_units"), chars.cast("long").alias("n_chars"))


@query("""WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
x AS (SELECT doc_id, lang, source, coalesce(string_agg(b, chr(10) ORDER BY i) FILTER (b <> ''), '') AS a FROM (SELECT *, trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')) AS b FROM l) GROUP BY ALL)
SELECT doc_id, 1 AS seq, '技术领域' AS section_name, a AS section_text FROM x WHERE a <> '' UNION ALL SELECT doc_id, CASE WHEN a <> '' THEN 2 ELSE 1 END, '附图说明', lang || source FROM x""")
def q_sections(spark, d):
    """Two headed sections around the whole text of each document."""
    lines = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: text.strip(F.regexp_replace(x, r"(?U:\s)+", " "))), lambda x: x != ""), "\n")
    body = F.concat(F.lit("前言\n 技术领域 \n"), lines, F.lit("\n说明书附图\n"), "lang", "source", F.lit("\n"))
    docs = t(spark, d, "documents").select("doc_id", body.alias("raw_text"))
    return patent.sections(docs, "doc_id").select("doc_id", "seq", "section_name", "section_text")


@query("""SELECT s_suppkey AS task_id, 'CN' || (1000000 + s_suppkey) AS patent_number, '2020-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS application_date, NULL::VARCHAR AS priority_date, s_name || s_nationkey AS title, s_name AS holder FROM supplier""")
def q_metadata(spark, d):
    """Bracket codes put together from suppliers."""
    s = F.col("s_suppkey")
    body = F.concat(F.lit("(21)申请号 CN"), (s + 1000000).cast("string"), F.lit("\n(22)申请日 2020."), F.lit("01."), F.lpad((s % 28 + 1).cast("string"), 2, "0"), F.lit("\n(73)专利权人 "), "s_name", F.lit("\n地址 某处\n(54)发明名称\n"), "s_name", F.lit("\n  "), F.col("s_nationkey").cast("string"), F.lit("\n(57)摘要"))
    return t(spark, d, "supplier").select(s.alias("task_id"), patent.metadata(body).alias("m")).select("task_id", "m.*")


@query("""SELECT p_partkey AS id, i AS place, p_partkey || chr(65 + i::INT) AS feature_id, [p_name, p_type, p_brand][i + 1] AS feature_text FROM part, range(3) r(i) WHERE NOT (i = 1 AND p_type = p_name) AND NOT (i = 2 AND p_brand IN (p_name, p_type))""")
def q_feature_split(spark, d):
    """Claims put together from part names, types and brands."""
    claim = F.concat("p_name", F.lit("，其特征在于，包括："), "p_type", F.lit("；以及"), "p_brand", F.lit("。"))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(patent.features(F.col("p_partkey").cast("string"), claim)).alias("place", "f"))
    return rows.select("id", F.col("place").cast("long").alias("place"), "f.feature_id", "f.feature_text")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CN' || (100000 + doc_id) || 'A' WHEN doc_id % 3 = 1 THEN (20200000 + doc_id) || '.5' END AS patent_number FROM documents""")
def q_patent_number(spark, d):
    """X40."""
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("见 cn "), (i + 100000).cast("string"), F.lit("a 号"))).when(i % 3 == 1, F.concat(F.lit("号 "), (i + 20200000).cast("string"), F.lit(".5 等"))).otherwise("无")
    return t(spark, d, "documents").select("doc_id", patent.patent_number(said).alias("patent_number"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]+)"')) AS n_links, 2 * (page_id % 2)::BIGINT AS n_images FROM pages""")
def q_html_image_urls(spark, d):
    """This corpus has no images, so odd pages get one (found as a tag and as a bare url); links are counted as they are."""
    more = F.concat("html", F.when(F.col("page_id") % 2 == 1, '<img src="http://x.test/a.png">').otherwise(""))
    return t(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("n_links"), F.size(patent.image_urls(more)).cast("long").alias("n_images"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def q_html_escape(spark, d):
    """X49."""
    return t(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped"))


@query("""WITH x AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(/.*)?$', 1) AS p FROM pages), e AS (SELECT *, regexp_extract(p, '[^./]\\.([^./]*)$', 1) AS ext FROM x)
SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS safe, CASE WHEN lower(ext) IN ('html', 'htm', 'pdf', 'txt', 'md', 'csv', 'json', 'xml') THEN 'document' WHEN lower(ext) IN ('png', 'jpg', 'jpeg', 'gif', 'webp') THEN 'image' ELSE 'default' END AS category FROM e""")
def q_file_names(spark, d):
    """X48, S6, S21 on urls."""
    return t(spark, d, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("safe"), rules.file_kind(F.col("url"))["category"].alias("category"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (regexp_extract(props, '\\d+'))::DOUBLE END AS k, event_type AS kind FROM events")
def q_tolerant_json(spark, d):
    """Fenced replies around JSON with a trailing comma; odd ones hold none."""
    fence = F.concat(F.lit("Here:\n```json\n"), F.replace("props", F.lit("}"), F.concat(F.lit(', "text": "'), "event_type", F.lit('",}'))), F.lit("\n```"))
    v = replies.tolerant_json(F.when(F.col("event_id") % 2 == 0, fence).otherwise("sorry"))
    return t(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "double").alias("k"), F.coalesce(replies.at(v, "text"), F.col("event_type")).alias("kind"))


@query("SELECT c_custkey AS id, left('Customer#', 12) || lpad((c_custkey // 1000000)::VARCHAR, 3, '0') AS holder_name, true AS enterprise FROM customer")
def q_holder_name(spark, d):
    """Customers as companies; names are cut at 12 characters."""
    holder = F.concat("c_name", F.lit(" (测试)股份有限公司"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), keywords.holder_name(holder).alias("holder_name"), keywords.is_enterprise(holder).alias("enterprise"))


@query("SELECT n_nationkey AS task_id, '图' || i AS figure_id, 'view of ' || n_name || CASE WHEN i = 2 THEN ' again' ELSE '' END AS description FROM nation, range(1, 4) r(i)")
def q_figure_descriptions(spark, d):
    """Grouped figures, a repaired label, and a later description of figure 2."""
    said = F.concat(F.lit("图1、图 2 和图3是view of "), "n_name", F.lit("；\n图l为view of "), "n_name", F.lit("。\n图2：view of "), "n_name", F.lit(" again。"))
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("task_id"), F.lit(1).alias("seq"), F.lit("附图说明").alias("section_name"), said.alias("section_text"))
    return patent.figure_descriptions(rows)


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN left(p_brand, 5) || '扫地机器人' WHEN 1 THEN '图像处理' WHEN 2 THEN (['水杯', '灯具', '座椅'])[p_size % 3 + 1] || '清洁' ELSE (['水杯', '灯具', '座椅'])[p_size % 3 + 1] END AS subject FROM part")
def q_subject(spark, d):
    """File names with noise around a subject: named goods, methods, devices, else the first Chinese words."""
    kind = F.col("p_partkey") % 4
    thing = F.get(F.array(F.lit("水杯"), F.lit("灯具"), F.lit("座椅")), (F.col("p_size") % 3).cast("int"))
    name = F.when(kind == 0, F.concat(F.lit("CN 1234567A【测试】"), F.left("p_brand", F.lit(5)), F.lit("扫地机器人-示例.pdf"))).when(kind == 1, "一种图像处理方法_专利分析.docx").when(kind == 2, F.concat(F.lit("用于"), thing, F.lit("清洁装置.pdf"))).otherwise(F.concat(thing, F.lit(" x.pdf")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), patent.subject(name).alias("subject"))


@query("SELECT n_nationkey AS doc, CASE WHEN n_regionkey = 0 THEN '2' WHEN n_regionkey = 1 THEN '3' WHEN n_regionkey = 2 THEN '3' ELSE '2,3' END AS pages FROM nation")
def q_figure_pages(spark, d):
    """Four pages a nation; by region an explicit page, a spaced heading, trailing images, and all after the heading."""
    kind = F.col("n_regionkey")
    words = F.lit("字" * 700)
    page = lambda i: F.when(F.lit(i) == 0, F.lit("摘要")).when(F.lit(i) == 1, F.when(kind == 2, words).otherwise(F.concat(F.lit("附 图 说 明"), words))).when(F.lit(i) == 2, F.when(kind == 0, F.concat(F.lit("说明书 附图"), words)).otherwise(words)).otherwise(F.when(kind.isin(1, 2), F.lit("图1")).otherwise(words))
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), "n_regionkey", F.explode(F.array(*(F.struct(F.lit(i).alias("page"), page(i).alias("text"), F.when((F.lit(i) == 3) & (kind == 2), 1).otherwise(0).alias("images"), F.lit(0).alias("drawings")) for i in range(4)))).alias("p"))
    described = t(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), F.lit(1).alias("n"))
    found = patent.candidate_pages(rows.select("doc", "p.*"), described)
    return found.select("doc", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("SELECT p_partkey AS doc, CASE p_size % 3 WHEN 0 THEN '图' || (p_partkey % 3 + 1) || ',' || CASE p_partkey % 3 WHEN 0 THEN '图2,图3' WHEN 1 THEN '图1,图3' ELSE '图1,图2' END ELSE '图1,图2,图3' END || ',图4,图5' AS ids FROM part")
def q_figure_ids(spark, d):
    """Parts as documents of five pages: a labelled first page or none, the described figures left, then numbers that go on."""
    first = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("图 "), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    ids = patent.figure_ids(F.array(patent.figure_labels(first), *(patent.figure_labels(F.col("p_name")) for _ in range(4))), F.array(F.lit("图1"), F.lit("图2"), F.lit("图3")))
    return t(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.array_join(ids, ",").alias("ids"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'a.e')) AS n_regex, (length(text) - length(replace(text, '. ', ''))) // 2 AS n_plain FROM documents")
def q_plain_terms(spark, d):
    """Terms are counted as plain text, whatever characters they have."""
    return t(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("a.e"), F.lit(0))).cast("long").alias("n_regex"), rules.occurrences(F.col("text"), (". ",)).cast("long").alias("n_plain"))


@query("SELECT p_partkey AS id, p_partkey || 'A' AS feature_id, p_name AS feature_text, p_partkey::VARCHAR AS claim_id FROM part")
def q_reply_features(spark, d):
    """Features of a reply; items without a text are left out."""
    i = F.col("p_partkey").cast("string")
    reply = F.concat(F.lit('{"features": [{"feature_id": "'), i, F.lit('A", "feature_text": "'), "p_name", F.lit('"}, {"feature_id": "x"}]}'))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(replies.reply_features(reply, i)).alias("f")).select("id", "f.*")


@query("SELECT p_partkey AS id, p_name AS point, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '说明书内容' END AS source FROM part")
def q_invention_point(spark, d):
    """X25."""
    reply = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("|"), "p_type")).otherwise(""))
    p = replies.invention_point(reply, F.lit("general"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), p["point"].alias("point"), p["source"].alias("source"))


@query("SELECT p_partkey AS id, p_name || '|' || p_type AS distinct_objects, p_name AS first_image FROM part")
def q_arrays(spark, d):
    """Distinct strings white space aside; the first item of a JSON array."""
    items = F.array(F.col("p_name"), F.concat(F.lit(" "), "p_name"), F.col("p_type"), F.concat("p_brand", F.lit(" ")), F.col("p_brand"))
    picture = F.concat(F.lit('["", "'), "p_name", F.lit('", "z"]'))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(dedup.without_spaces(items, F.col("p_brand")), "|").alias("distinct_objects"), text.first_image(picture).alias("first_image"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/bmp' ELSE 'image/png' END AS mime, page_id % 4 = 0 AS recoverable FROM pages")
def q_mime_and_errors(spark, d):
    """X22, J24."""
    kind = F.col("page_id") % 4
    name = F.concat("url", F.when(kind == 0, ".JPG").when(kind == 1, ".gif").when(kind == 2, ".bmp").otherwise(".x"))
    said = F.when(kind == 0, "Fetch failed: 504").otherwise("bad input")
    return t(spark, d, "pages").select("page_id", rules.image_mime(name).alias("mime"), rules.recoverable(said).alias("recoverable"))
