"""Queries on replies of external models: parts as replies, each in one of several arms, well-formed or broken, by its key. The SQL beside each
states what the rule gives for the arm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patent, replies
from ..operators import contracts
from ..sources import files
from .tabular import t

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def say(template: str) -> Column:
    """A reply with N, T, B and K in double brackets as the part's name, type, brand and key."""
    c = F.lit(template)
    for mark, name in (("N", "p_name"), ("T", "p_type"), ("B", "p_brand"), ("K", "p_partkey")):
        c = F.replace(c, F.lit(f"<<{mark}>>"), F.col(name).cast("string"))
    return c


def arms(*templates: str) -> Column:
    """The reply of the arm that the part's key gives."""
    out = F.when(F.lit(False), "")
    for i, x in enumerate(templates):
        out = out.when(F.col("p_partkey") % len(templates) == i, say(x))
    return out


def joined(items: Column, *fields: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat_ws("@", *(x[f].cast("string") for f in fields))), "|")


@query("""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN p_name || '@unknown@@0.9' WHEN 1 THEN p_name || '@use@src@0.8|' || p_type || '@unknown@coerced@0.7' WHEN 2 THEN p_name || '@unknown@why@0.5' WHEN 3 THEN p_brand || '@unknown@fallback@0.6|' || p_type || '@unknown@fallback@0.6' WHEN 4 THEN p_name || '@unknown@coerced@0.7' WHEN 5 THEN p_brand || '@unknown@fallback@0.6|' || p_type || '@unknown@fallback@0.6' WHEN 6 THEN '0@unknown@@0.8' WHEN 7 THEN p_type || '@unknown@@1.0' ELSE p_brand || '@unknown@fallback@0.6|' || p_type || '@unknown@fallback@0.6' END AS terms,
CASE p_partkey % 9 WHEN 0 THEN 'kept' WHEN 3 THEN '筛选结果为空，已回退为直接使用原始核心术语' WHEN 5 THEN 'none' WHEN 8 THEN '筛选结果为空，已回退为直接使用原始核心术语' ELSE '' END AS log FROM part""")
def q_filtered_terms(spark, d):
    """Containers and keys in other spellings, Python literals, trailing commas, zero and odd confidences, texts, replies without terms, and lists of objects, whose
    outermost {..} is read first and is no list."""
    reply = arms(
        '{"core_terms": [{"term": "<<N>>", "score": 0.9}, {"term": ""}], "filter_log": "kept"}',
        '```json\n{"Filtered Terms": [{"Text": " <<N>> ", "term": "x", "Category": "use", "confidence": 0, "source": "src"}, "<<T>>",]}\n```',
        "{'keywords': [{'text': '', 'keyword-text': '<<N>>', 'confidence': '0.5', 'reason': 'why', 'ok': None}]}",
        "sorry, nothing [here",
        'these: ["<<N>>", " ", 5]',
        '{"core_terms": 7, "terms": [{"text": "<<N>>"}], "message": "none"}',
        '{"terms": [{"text": "0", "confidence": "high"}]}',
        '{"results": ["x"], "terms": [{"keyword": "<<T>>", "text": null, "confidence": true}]}',
        '[{"text": "<<N>>"}, {"text": "<<T>>"}]',
    )
    f = replies.filtered_terms(reply, F.array("p_brand", F.lit(""), "p_type"))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), f.alias("f"))
    return rows.select("id", joined(F.col("f.terms"), "text", "category", "source_location", "confidence").alias("terms"), F.col("f.log").alias("log"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '|' || p_brand WHEN 3 THEN '5' ELSE '' END AS scenarios, CASE p_partkey % 5 WHEN 0 THEN p_type || '|' || p_brand WHEN 1 THEN p_type ELSE '' END AS audiences FROM part""")
def q_tagged_lists(spark, d):
    """Lists of an object; tagged lines of a broken one; nothing of a reply without one, or of values that are no lists."""
    reply = arms('ok {"scenario_words": ["<<N>>", " "], "audience_words": [" <<T>>", "<<B>>"]} end', "{broken}\n使用场景：\n- <<N>>\n2、<<B>>\n-\n目标人群：\n1. <<T>>", "使用场景：\n- <<N>>\n目标人群：\n1. <<T>>", '{"scenario_words": [5], "audience_words": "<<T>>"}', '{"scenarios": ["<<N>>"]}')
    found = replies.tagged_lists(reply)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(found["scenario_words"], "|").alias("scenarios"), F.array_join(found["audience_words"], "|").alias("audiences"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || '@src@T|' || p_type || '@精炼生成@REFINED_FEATURE' WHEN 1 THEN '[x@精炼生成@REFINED_FEATURE|' || p_name || '@精炼生成@REFINED_FEATURE|]@精炼生成@REFINED_FEATURE' ELSE p_brand || '@o@O' END AS refined, CASE p_partkey % 5 WHEN 0 THEN 'dropped ' || p_brand WHEN 1 THEN '' ELSE '精炼结果为空，保留原始术语' END AS log,
p_name || ':' || p_type AS words, p_name || p_type AS content FROM part""")
def q_reply_terms(spark, d):
    """Refined terms with their log, lines of a list that doesn't parse, else the originals; scene words; content parts."""
    reply = arms('[{"text": "<<N>>", "source": "src", "type": "T"}, {"text": "<<T>>"}, "x"]\n- dropped <<B>>', "[x\n1. <<N>>\n精炼说明\n说明：y\n]", "1. <<N>>\n2. <<T>>", '["<<N>>"] log', "[]")
    refined = replies.refined_terms(reply, F.array(F.struct(F.col("p_brand").alias("text"), F.lit("o").alias("source"), F.lit("O").alias("type"))))
    scenes = replies.scene_words(say('[{"text": "<<N>>", "category": "<<T>>"}]'))
    content = replies.flat_content(say('[{"type": "text", "text": "<<N>>"}, "<<T>>"]'))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), refined.alias("r"), F.array_join(F.transform(scenes, lambda s: F.concat_ws(":", s["text"], s["category"])), "|").alias("words"), content.alias("content"))
    return rows.select("id", joined(F.col("r.terms"), "text", "source", "type").alias("refined"), F.col("r.log").alias("log"), "words", "content")


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'general' ELSE 'fitness' END AS variant, * FROM part)
SELECT id, CASE id % 4 WHEN 0 THEN p_name || '@' || p_type || '@p@0.9|' || p_brand || '@unknown@@0.8' WHEN 1 THEN CASE variant WHEN 'general' THEN '1. ' || p_name || '@unknown@text_extraction@0.6|[' || p_type || '@unknown@text_extraction@0.6|ab]@unknown@text_extraction@0.6' ELSE '1. ' || p_name || '@unknown@text_extraction@0.6|[' || p_type || '@unknown@text_extraction@0.6' END
WHEN 2 THEN CASE variant WHEN 'general' THEN '1. ' || p_name || '@unknown@text_extraction@0.6|x@unknown@text_extraction@0.6' ELSE '' END ELSE '' END AS keywords FROM x""")
def q_combined_keywords(spark, d):
    """Objects with a text; lines where there is no list or it doesn't parse, by variant; an empty list stays empty."""
    reply = arms('found [{"keyword_text": "<<N>>", "keyword_type": "<<T>>", "combination_pattern": "p", "confidence": 0.9}, {"keyword_text": ""}, "x", {"keyword_text": "<<B>>"}]', "1. <<N>>\n[<<T>>\n\nab]", "1. <<N>>\n x", "none: []")
    k = replies.combined_keywords(reply, F.when(F.col("p_size") % 2 == 0, "general").otherwise("fitness"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), joined(k, "keyword_text", "keyword_type", "combination_pattern", "confidence").alias("keywords"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name || '@权利要求原文@CORE_TERM|' || p_type || '@权利要求原文@CORE_TERM' WHEN 1 THEN p_name || '@@|' || p_type || '@s@T' ELSE '[' || p_name || '@权利要求原文@CORE_TERM|]@权利要求原文@CORE_TERM' END AS listed, 2 AS n FROM part""")
def q_listed_terms(spark, d):
    """Numbered lines; texts and objects of a list; the lines of a list that doesn't parse."""
    terms = replies.listed_terms(arms("1. <<N>>\n\n2、<<T>>", '```\n["<<N>>", {"text": "<<T>>", "source": "s", "type": "T"}]\n```', "[<<N>>\n3. ]"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), joined(terms, "text", "source", "type").alias("listed"), F.size(terms).alias("n"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 3 THEN 'a' WHEN 4 THEN '' ELSE p_name END AS primary_object, CASE p_partkey % 5 WHEN 0 THEN p_type || '|q' WHEN 1 THEN p_type WHEN 2 THEN p_type || '|' || p_brand WHEN 3 THEN 'b' ELSE 'z' END AS search,
CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN p_type ELSE '' END AS grounded FROM part""")
def q_product_objects(spark, d):
    """An object, a list, a split text without its label and quotes, the shortest list of the other variants; none twice."""
    reply = arms('{"primary_product_object": " <<N>> ", "search_product_objects": ["<<T>>", "<<N>>", 7, " ", "q", "<<T>> "]}', '["<<N>>", "<<T>>", "<<T>>"]', "结果：\"<<N>>\"，<<T>>、 '<<B>>'\n<<T>>", 'x ["a", "b"] y ["c"]', '{"search_product_objects": ["z"]}')
    o = replies.product_objects(reply, F.when(F.col("p_partkey") % 5 == 3, "fitness").otherwise("general"))
    rows = t(spark, d, "part").select("p_partkey", "p_type", o.alias("o"))
    kept = replies.grounded(F.col("o.search"), F.col("o.primary"), F.regexp_replace("p_type", " ", ""))
    return rows.select(F.col("p_partkey").alias("id"), F.col("o.primary").alias("primary_object"), F.array_join("o.search", "|").alias("search"), F.array_join(kept, "|").alias("grounded"))


@query("""WITH a AS (SELECT *, p_partkey AS id, p_partkey % 6 AS arm FROM part)
SELECT id, 0 AS place, CASE arm WHEN 5 THEN '' ELSE p_name END AS product_name, CASE arm WHEN 0 THEN p_type WHEN 3 THEN '0' ELSE '' END AS product_source, CASE arm WHEN 1 THEN p_brand ELSE '' END AS manufacturer, CASE arm WHEN 1 THEN 'own' ELSE p_type END AS matched_keywords, CASE arm WHEN 0 THEN 'u' WHEN 2 THEN 'v' ELSE '' END AS picture, CASE arm WHEN 3 THEN '5' ELSE '' END AS price FROM a WHERE arm <> 4
UNION ALL SELECT id, 1, p_brand, '', '', p_type, '', '' FROM a WHERE arm = 0""")
def q_product_replies(spark, d):
    """The first list of an object (an empty one gives way to a single product), a list in a text, a single product by its title,
    name or url; aliases, empty fields, and the keyword searched for. A name and a link alone are no product."""
    reply = arms(
        '{"note": 1, "data": [{"title": "<<N>>", "product_name": "", "platform": "<<T>>", "picture": [], "images": ["u"]}, {"name": "<<B>>", "price": 0}], "items": []}',
        '{"products": [], "title": "<<N>>", "manufacturer": "", "Manufacturer": "<<B>>", "matched_keywords": "own"}',
        'found: [{"name": "<<N>>", "image_urls": ["v"]}] and more',
        '[{"product_name": "<<N>>", "source": "0", "price": 5, "brand": false}]',
        '{"name": "<<N>>", "link": "x"}',
        '{"url": null}',
    )
    items = F.transform(replies.product_items(reply), lambda x: replies.product(x, F.col("p_type")))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(items).alias("place", "p"))
    return rows.select("id", "place", "p.product_name", "p.product_source", "p.manufacturer", "p.matched_keywords", F.array_join("p.picture", "|").alias("picture"), "p.price")


_CLAIMS = ('{"claims": [}', "sorry", '{"claims": [{"claim_id": 1, "claim_text": "<<N>>"}, {"claim_type": "OTHER"}]}', '{"claims": [{"claim_id": 1, "claim_text": "<<N>>"}]}', '```json\n{"claims": [{"claim_id": "1", "claim_type": "INDEPENDENT", "claim_text": "<<N>>", "sentence_units": ["a", "b"]}, {"claim_id": "2", "claim_type": "DEPENDENT", "claim_text": "<<T>>", "parent_claim_id": "1"}]}\n```', '{"claims": [{"claim_id": "1", "claim_text": null}, {"parent_claim_id": 3}, {"sentence_units": ["a", 1]}]}', '{"claims": ["x", {"claim_id": "7", "claim_text": "<<B>>", "parent_claim_id": null}]}')


def claim_replies(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("task_id"), arms(*_CLAIMS).alias("reply"), say("1. 一种<<N>>。\n2. 根据权利要求1所述的<<T>>。").alias("claims_text"))


@query("""WITH a AS (SELECT *, p_partkey AS task_id, p_partkey % 7 AS arm FROM part), r(arm, seq, claim_id, kind, parent, units) AS (VALUES (3, 0, '1', 'INDEPENDENT', NULL, ''), (4, 0, '1', 'INDEPENDENT', NULL, 'a|b'), (4, 1, '2', 'DEPENDENT', '1', ''), (6, 0, '7', 'INDEPENDENT', NULL, ''))
SELECT task_id, seq, claim_id, kind AS claim_type, CASE WHEN a.arm = 6 THEN p_brand WHEN seq = 1 THEN p_type ELSE p_name END AS claim_text, parent AS parent_claim_id, units, 'reply' AS origin FROM a JOIN r ON r.arm = a.arm
UNION ALL SELECT task_id, i - 1, i::VARCHAR, CASE i WHEN 1 THEN 'INDEPENDENT' ELSE 'DEPENDENT' END, x, CASE i WHEN 2 THEN '1' END, x, 'rules' FROM (SELECT task_id, arm, i, CASE i WHEN 1 THEN '一种' || p_name || '。' ELSE '根据权利要求1所述的' || p_type || '。' END AS x FROM a, range(1, 3) s(i)) WHERE arm IN (0, 2, 5)""")
def q_claims_reply(spark, d):
    """Claims contract, X6: replies in seven arms, one of them broken JSON, one without any, two against the contract."""
    return contracts.claims_reply(claim_replies(spark, d)).accepted.withColumn("units", F.array_join("sentence_units", "|")).drop("sentence_units").withColumn("seq", F.col("seq").cast("int"))


@query("""SELECT p_partkey AS task_id, seq, reason FROM part JOIN (VALUES (0, NULL, 'NOT_JSON'), (2, 1, 'claim_type'), (5, 0, 'claim_text'), (5, 1, 'parent_claim_id'), (5, 2, 'sentence_units')) r(arm, seq, reason) ON r.arm = p_partkey % 7""")
def q_claims_rejects(spark, d):
    """Claims contract: what was rejected and why."""
    return contracts.claims_reply(claim_replies(spark, d)).rejects.select("task_id", "seq", "reason")


@query("""WITH a AS (SELECT *, p_partkey AS task_id, p_partkey % 7 AS arm FROM part)
SELECT task_id, CASE arm WHEN 0 THEN '技术领域@' || p_name || '@3|背景技术@' || p_type || '@-1|附图说明@@0' WHEN 1 THEN '' WHEN 3 THEN '@@0|技术领域@f@-1|附图说明@@0' WHEN 4 THEN '技术领域@f@-1|附图说明@@0' ELSE '技术领域@f@-1|附图说明@@0' END AS sections, CASE arm WHEN 0 THEN 'claims of ' || p_brand WHEN 1 THEN '' ELSE 'fallback' END AS claims_section,
CASE arm WHEN 0 THEN p_brand || '@' || p_name || '@h' WHEN 1 THEN NULL WHEN 4 THEN p_type || '@' || p_name || '@h' ELSE 'CN@' || p_name || '@h' END AS metadata, CASE WHEN arm IN (2, 5, 6) THEN 'rules' ELSE 'reply' END AS origin FROM a""")
def q_structure_reply(spark, d):
    """Structure contract, X5, J7, J8: sections with their places, then fallback sections of other names; metadata in tiers; broken replies."""
    reply = arms(
        '{"sections": [{"name": "技术领域", "text": "<<N>>"}, 5, {"name": "背景技术", "text": "<<T>>"}], "claims_section": "claims of <<B>>", "metadata": {"patent_number": "<<B>>", "title": ""}}',
        "no object", "{broken}", '{"sections": [{}], "claims_section": ""}', '{"metadata": {"patent_number": "<<T>>"}}', '{"sections": {"name": "x"}}', '{"sections": [{"name": null, "text": "x"}]}',
    )
    section = lambda n, x: F.struct(F.lit(n).alias("section_name"), F.lit(x).alias("section_text"))
    meta = lambda **known: F.struct(*(known.get(n, F.lit(None).cast("string")).alias(n) for n in contracts.METADATA))
    rows = t(spark, d, "part").select(
        F.col("p_partkey").alias("task_id"), reply.alias("reply"), F.concat(F.lit("前言。"), "p_name").alias("raw_text"), F.array(section("技术领域", "f"), section("附图说明", "")).alias("fallback_sections"), F.lit("fallback").alias("fallback_claims"),
        meta(patent_number=F.lit("CN"), title=F.lit("")).alias("cn_metadata"), meta(patent_number=F.lit("z"), title=F.col("p_name"), patent_holder=F.lit("h")).alias("fallback_metadata"),
    )
    m = F.col("metadata")
    return contracts.structure_reply(rows).accepted.select("task_id", joined(F.col("sections"), "section_name", "section_text", "start_position").alias("sections"), "claims_section", F.when(m.isNotNull(), F.concat_ws("@", m["patent_number"], m["title"], m["patent_holder"])).alias("metadata"), "origin")


@query("""WITH a AS (SELECT *, p_partkey AS task_id, p_partkey % 7 AS arm FROM part), f(i, feature_id) AS (VALUES (0, 'A'), (1, 'B')),
o AS (SELECT task_id, arm, p_name, p_brand, 'A' AS feature_id, 0 AS seq, CASE WHEN arm = 1 THEN '可判断不具有' WHEN arm = 2 THEN '相关信息缺失' ELSE '文字直接公开' END AS kind, CASE WHEN arm = 2 THEN '明确没有' || p_name ELSE p_name END AS reason, CASE arm WHEN 0 THEN p_brand ELSE '' END AS images FROM a WHERE arm IN (0, 1, 2, 5))
SELECT task_id, seq, feature_id, reason, kind AS reasoning_type, images, 'reply' AS origin, CASE WHEN kind = '文字直接公开' THEN 'MATCH' ELSE 'NO_MATCH' END AS comparison_result FROM o
UNION ALL SELECT task_id, 1, 'B', 'LLM未返回该特征的分析结果', '相关信息缺失', '', 'missing', 'UNCERTAIN' FROM o
UNION ALL SELECT task_id, i, feature_id, 'LLM未返回该特征的分析结果', '相关信息缺失', '', 'missing', 'UNCERTAIN' FROM a, f WHERE arm IN (3, 6)
UNION ALL SELECT task_id, i, feature_id, '大模型返回格式异常，无法解析', '相关信息缺失', '', 'format', 'UNCERTAIN' FROM a, f WHERE arm = 4""")
def q_analysis_reply(spark, d):
    """Analysis contract, Q9, A1: features with images, features left out, broken replies."""
    item = '{"feature_id": "A", "reason": "<<N>>", "reasoning_type": "文字直接公开"}'
    reply = arms(
        '{"analysis": [{"feature_id": "A", "reason": "<<N>>", "reasoning_type": "文字直接公开", "evidence_images": ["<<B>>", " ", 3]}]}', '```json\n[{"feature_id": "A", "reason": "<<N>>", "reasoning_type": "可判断不具有", "evidence_images": "x"}]\n```',
        'so: [{"feature_id": "A", "reason": "明确没有<<N>>"}] end', "broken [", '{"other": []}', '[{"reason": "no id"}, "x", ' + item + "]", '{"analysis": []}',
    )
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("task_id"), reply.alias("reply"), F.array(*(F.struct(F.lit(x).alias("feature_id"), F.lit("1").alias("claim_id")) for x in "AB")).alias("features"))
    return contracts.analysis_reply(rows).accepted.select("task_id", "seq", "feature_id", "reason", "reasoning_type", F.array_join("evidence_images", "|").alias("images"), "origin", "comparison_result")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '扫地机器人专利分析' WHEN 1 THEN '图像处理专利分析' WHEN 2 THEN p_name ELSE '专利分析' END AS title FROM part""")
def q_session_title(spark, d):
    """The subject of a title, else of a file name; else the title itself, else the bare word."""
    i = F.col("p_partkey") % 4
    title = F.when(i == 0, F.concat(F.lit("CN 1234567A【测试】"), F.lit("扫地机器人"))).when(i == 2, F.concat(F.lit(" "), "p_name"))
    name = F.when(i == 0, "一种图像处理方法").when(i == 1, F.concat(F.lit("一种图像处理方法_"), F.lit("专利分析.docx"))).otherwise("")
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), patent.session_title([title, F.lit(None).cast("string")], [name, F.lit("")]).alias("title"))


@query("""SELECT (['商品', 'Product ', '侵权分析 ', '检索结果', 'x', 'y', 'z'])[p_partkey % 7 + 1] || p_partkey AS table_name, CASE p_partkey % 7 WHEN 0 THEN 'products' WHEN 1 THEN 'products' WHEN 2 THEN 'comparisons' WHEN 3 THEN 'products' WHEN 4 THEN 'products' WHEN 5 THEN 'comparisons' END AS kind FROM part""")
def q_table_kinds(spark, d):
    """Parts as tables of one record: the kind by what the name contains, else by what the columns contain."""
    i = F.col("p_partkey")
    name = F.concat(F.get(F.array(*map(F.lit, ("商品", "Product ", "侵权分析 ", "检索结果", "x", "y", "z"))), (i % 7).cast("int")), i.cast("string"))
    record = F.get(F.array(*map(F.lit, ("{}", '{"claim": 1}', '{"商品名称": 1}', "{}", '{"商品名称": 1, "Claim": 2}', '{"商品": 1, "权利要求特征": 2}', '{"name": 1}'))), (i % 7).cast("int"))
    return files.kinds(t(spark, d, "part").select(name.alias("table_name"), F.lit(1).alias("seq"), F.parse_json(record).alias("record")))
