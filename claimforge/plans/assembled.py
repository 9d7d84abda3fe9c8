"""Queries on records, projections, replies, files and scopes. The SQL beside each says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells, keywords, patent, replies, rules, text
from ..operators import assembly, lifecycle, lookup
from ..sources import files, sinks
from .tabular import t

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def q(c: str):
    return F.concat(F.lit('"'), c, F.lit('"'))


def records(spark, d):
    """Parts as records of a scanned table; every third cell is a list of parts, and one record is broken."""
    i = F.col("p_partkey")
    name = F.when(i % 3 == 0, F.concat(F.lit('[{"type": "text", "text": '), q("p_name"), F.lit('}, "!"]'))).when(i % 3 == 1, F.concat(F.lit('{"text": '), q("p_name"), F.lit("}"))).otherwise(q("p_name"))
    link = F.when(i % 2 == 0, F.concat(F.lit('[{"link": "http://x/'), i.cast("string"), F.lit('"}]'))).otherwise(F.concat(F.lit('"http://y/'), i.cast("string"), F.lit('"')))
    body = F.concat(F.lit('{"商品名称": '), name, F.lit(', "链接": '), link, F.lit(', "价格": '), F.col("p_size").cast("string"), F.lit(', "product_id": '), q("p_brand"), F.lit(', "比对结果": '), F.when(i % 2 == 0, '"匹配"').otherwise('"?"'), F.lit(', "drawings": "a\\n\\n b "}'))
    rows = t(spark, d, "part").select(F.lit("products").alias("table_name"), i.alias("seq"), body.alias("record_json"))
    broken = spark.range(1).select(F.lit("products").alias("table_name"), F.lit(0).cast("long").alias("seq"), F.lit("{").alias("record_json"))
    return cells.table_records(rows.union(broken), ["products"])


@query("""SELECT p_partkey AS seq, 'product_' || p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS product_name, 'http://' || CASE WHEN p_partkey % 2 = 0 THEN 'x/' ELSE 'y/' END || p_partkey AS product_url, p_size::VARCHAR AS price, p_size::DOUBLE AS price_number, 'a|b' AS drawings FROM part""")
def q_record_products(spark, d):
    """Records to products; cells of text, parts, links, numbers and lists."""
    rows = records(spark, d).select("seq", cells.product_record(F.col("record"), F.col("seq")).alias("p"), cells.number_cell(F.col("record"), "价格").alias("price_number"), F.array_join(cells.patent_record(F.col("record"))["drawings"], "|").alias("drawings"))
    return rows.select("seq", "p.product_id", "p.product_name", "p.product_url", "p.price", "price_number", "drawings")


@query("SELECT p_partkey AS seq, p_brand AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 'matching' ELSE 'uncertain' END AS status, CASE WHEN p_partkey % 2 = 0 THEN '匹配' ELSE '?' END AS result FROM part")
def q_record_comparisons(spark, d):
    """Records to comparison rows."""
    return cells.comparison_rows(records(spark, d)).select("seq", "product_id", "status", "result")


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS application_date, CASE WHEN lang = 'de' THEN text ELSE source || chr(10) || coalesce(text, '') END AS invention_content FROM documents")
def q_loader_projection(spark, d):
    """Documents as patents whose second section is the invention in one language only."""
    section = lambda n, x: F.struct(n.alias("section_name"), x.alias("section_text"))
    sections = F.array(section(F.lit("技术领域"), F.col("source")), section(F.when(F.col("lang") == "de", "发明内容").otherwise("其他"), F.col("text")))
    patents = t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("application_date"), F.col("source").alias("priority_date"), F.lit("h").alias("patent_holder"), F.lit("n").alias("patent_number"), sections.alias("sections"))
    return assembly.loaded(patents).select("doc_id", "application_date", "invention_content")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS patent_number, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, 'x') AS title FROM part")
def q_metadata_tiers(spark, d):
    """A field from the reply, else from the codes, else from the fallback."""
    tier = lambda number, title: F.struct(number.alias("patent_number"), title.alias("title"))
    m = assembly.filled(tier(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit(None).cast("string")), tier(F.col("p_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))), tier(F.lit("z"), F.lit("x")), fields=("patent_number", "title"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), m["patent_number"].alias("patent_number"), m["title"].alias("title"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE instr(coalesce(text, ''), lang) - 1 END AS start_position, CASE WHEN lang = 'fr' THEN 0 ELSE instr(coalesce(text, ''), lang) + 1 END AS end_position, CASE WHEN length(text) > 4000 THEN left(text, 4000) || '...' ELSE text END AS excerpt FROM documents")
def q_offsets(spark, d):
    """Where a document first has its language's code; texts cut with a notice."""
    section = F.when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    o = assembly.offsets(F.coalesce("text", F.lit("")), section)
    return t(spark, d, "documents").select("doc_id", o["start_position"].alias("start_position"), o["end_position"].alias("end_position"), assembly.excerpt(F.col("text"), "industry", "...").alias("excerpt"))


@query("SELECT c_custkey AS run_id, coalesce(o_orderkey::VARCHAR, 'EMPTY') AS keyword_id, coalesce(o_orderpriority, '') AS keyword_text FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def q_empty_keywords(spark, d):
    """Customers as runs, orders as keywords."""
    words = t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").cast("string").alias("keyword_id"), F.col("o_orderpriority").alias("keyword_text"))
    return assembly.keyword_rows(t(spark, d, "customer").select(F.col("c_custkey").alias("run_id")), words, "general")


@query("SELECT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_partkey::VARCHAR END AS id, p_name AS name, '' AS description, 0 AS n_images FROM part")
def q_compare_input(spark, d):
    """J16."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("product_id"), F.col("p_name").alias("product_name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("picture"), F.lit(None).cast("string").alias("raw_payload"))
    return assembly.compare_input(rows).select("id", "name", "description", F.size("images").alias("n_images"))


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' AS stop, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS critical, CASE WHEN o_orderstatus = 'F' THEN 'c,f' ELSE 'r,c,f' END AS recoverable FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'P' END AS o_orderstatus FROM orders)")
def q_errors(spark, d):
    """Errors in order, split by whether the run can go on."""
    error = lambda kind, ok: F.struct(kind.alias("kind"), ok.alias("is_recoverable"))
    fatal = F.col("o_orderstatus") == "F"
    found = assembly.all_errors(F.when(~fatal, error(F.lit("r"), F.lit(True))), F.array(error(F.lit("c"), F.lit(True))), F.when(fatal, F.array(error(F.lit("F"), F.lit(False)))), F.array(error(F.lit("f"), F.lit(True))))
    s = assembly.split_errors(found)
    names = lambda c: F.array_join(F.transform(s[c], lambda e: e["kind"]), ",")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s["stop"].alias("stop"), names("critical").alias("critical"), names("recoverable").alias("recoverable"))


@query("SELECT conv_id AS record_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'user'), '') AS own, count(*) FILTER (role <> 'user') AS n_other FROM conversations WHERE regexp_matches(text, '[^\\s\\p{Z}]') GROUP BY 1")
def q_claim_lists(spark, d):
    """Turns as claims, user turns as independent ones."""
    claims = t(spark, d, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("seq"), F.col("text").alias("claim_text"), F.when(F.col("role") == "user", "INDEPENDENT").otherwise("DEPENDENT").alias("claim_type"))
    return assembly.claim_lists(claims).select("record_id", F.array_join("independent_claims", "|").alias("own"), F.size("dependent_claims").cast("long").alias("n_other"))


@query("SELECT l_suppkey AS run_id, count(DISTINCT l_linenumber) AS n_claims FROM lineitem GROUP BY 1")
def q_claim_count(spark, d):
    """A19."""
    return assembly.claim_count(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("claim_id")), "run_id")


@query("SELECT max(o_orderkey) AS id FROM orders")
def q_latest_run_id(spark, d):
    """A15."""
    return assembly.latest_run(t(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS n_pending, count(*) FILTER (o_orderstatus <> 'P') AS n_other FROM orders")
def q_user_split(spark, d):
    """Orders in progress as users that wait."""
    return assembly.user_split(t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").alias("status")))


@query("SELECT c_custkey AS session_id, o_orderkey AS id FROM customer JOIN orders ON o_custkey = CASE WHEN c_nationkey % 2 = 0 THEN c_custkey ELSE c_nationkey END")
def q_scoped_products(spark, d):
    """Orders as products; customers of even nations name a run, the others a patent."""
    even = F.col("c_nationkey") % 2 == 0
    scopes = t(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(even, F.array(F.col("c_custkey").cast("long"))).otherwise(F.array().cast("array<long>")).alias("run_ids"), F.col("c_nationkey").cast("long").alias("patent_id"))
    products = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("search_run_id"), F.col("o_custkey").cast("long").alias("patent_record_id"))
    return assembly.scoped_products(scopes, products).select("session_id", "id")


@query("SELECT p_brand AS keyword FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT n_name FROM nation")
def q_appended_keywords(spark, d):
    """U1."""
    part = t(spark, d, "part")
    return assembly.appended(part.select(F.col("p_brand").alias("keyword")), part.select(F.col("p_type").alias("keyword")), t(spark, d, "nation").select(F.col("n_name").alias("keyword")))


@query("SELECT l_suppkey AS run_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey, l_orderkey, l_linenumber) AS products FROM lineitem GROUP BY 1")
def q_output_order(spark, d):
    """The rows of each run as they come out in order of product and id."""
    rows = assembly.in_order(t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_orderkey", "l_linenumber")
    placed = rows.withColumn("place", F.monotonically_increasing_id())  # rises with the order of the output
    return placed.groupBy(F.col("l_suppkey").alias("run_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("products"))


@query("""SELECT s_suppkey AS id, '1. ' || repeat(s_name || '，', 20) || chr(10) || '2. 根据权利要求1所述的' || s_name AS block, CASE WHEN s_nationkey % 2 = 0 THEN '' ELSE 'CLAIMS_PARSE_ERROR,CLAIMS_NUMBERING_ERROR' END AS errors FROM supplier""")
def q_claims_block(spark, d):
    """The claims between their heading and the description's; errors of a block and of a rest without claims."""
    body = F.concat(F.lit("1. "), F.repeat(F.concat("s_name", F.lit("，")), F.lit(20)), F.lit("\n2. 根据权利要求1所述的"), "s_name")
    text = F.concat(F.lit("摘要\n权 利 要 求 书\n"), body, F.lit("\n说明书\n技术领域\n涉及"), "s_name")
    block = patent.claims_block(text)
    errors = patent.claim_errors(F.when(F.col("s_nationkey") % 2 == 0, block).otherwise("短"))
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), block.alias("block"), F.array_join(F.transform(errors, lambda e: e["error_type"]), ",").alias("errors"))


@query("SELECT conv_id AS task_id, turn::VARCHAR AS claim_id, turn AS depth FROM (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn FROM conversations)")
def q_claim_depth(spark, d):
    """X11: turns as claims, each dependent on the one before."""
    low = F.min("turn").over(Window.partitionBy("conv_id"))
    place = t(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), (F.col("turn") - low).alias("n"))
    rows = place.select("task_id", F.col("n").cast("string").alias("claim_id"), F.when(F.col("n") > 0, (F.col("n") - 1).cast("string")).alias("parent_claim_id"))
    return patent.claim_depth(rows).select("task_id", "claim_id", "depth")


@query("SELECT page_id, page_id % 2 = 0 AS missing, CASE page_id % 3 WHEN 0 THEN 'tok' || page_id WHEN 1 THEN repeat('a', 20) || page_id END AS token, CASE page_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'retry' WHEN page_id % 3 = 0 THEN 'wait；ask' ELSE '' END AS advice FROM pages")
def q_predicates(spark, d):
    """X37, X42, X50, J25."""
    i = F.col("page_id")
    reply = F.when(i % 2 == 0, F.concat(F.lit("请提供权利要求编号 "), i.cast("string"))).otherwise("ok")
    url = F.when(i % 3 == 0, F.concat(F.lit("https://x/base/tok"), i.cast("string"), F.lit("?t=1"))).when(i % 3 == 1, F.concat(F.repeat(F.lit("a"), F.lit(20)), i.cast("string"))).otherwise("https://x/y")
    head = F.when(i % 3 == 0, F.unhex(F.lit("89504E470D0A"))).when(i % 3 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("00")))
    message = F.when(i % 2 == 0, "504").when(i % 3 == 0, "limit quota").otherwise("x")
    advice = rules.hints(message, (("504", "retry"), ("limit", "wait"), ("quota", "ask")))
    return t(spark, d, "pages").select("page_id", rules.missing_context(reply).alias("missing"), patent.app_token(url).alias("token"), rules.image_kind(F.lit(None).cast("string"), head).alias("kind"), advice.alias("advice"))


@query("SELECT c_custkey AS id, left(replace(c_name, '#', '#'), 12) || '同款' || c_mktsegment AS keyword, 'HOLDER_BASED' AS kind FROM customer")
def q_holder_keyword(spark, d):
    """The keyword that a company's name gives; legal wording is passed over."""
    k = keywords.holder_keyword(F.concat("c_name", F.lit("股份有限公司")), F.lit("主"), F.array(F.lit("用于x"), F.col("c_mktsegment")), F.array().cast("array<string>"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), k["keyword_text"].alias("keyword"), keywords.display_type(k["keyword_type"]).alias("kind"))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS first_full, CASE WHEN length(c_name) > 10 THEN left(c_name, 10) || '...' ELSE c_name END AS short, 'A' || chr(10) || c_name || chr(10) || chr(10) || 'C' || chr(10) || c_mktsegment AS outline, c_nationkey % 2 = 0 AS general, c_nationkey % 2 = 0 AS fitness, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE 'RECORD-' || c_custkey END AS claim_id,
CASE WHEN c_nationkey % 2 = 0 THEN 'INDEPENDENT' ELSE 'DEPENDENT' END AS kind FROM customer""")
def q_projections(spark, d):
    """J1, J2, J6, J11-J13, J31."""
    even = F.col("c_nationkey") % 2 == 0
    claim = F.when(even, F.col("c_name")).otherwise(" ")
    section = lambda n, x: F.struct(F.lit(n).alias("section_name"), x.alias("section_text"))
    sections = F.array(section("A", F.col("c_name")), section("B", F.lit("　 ")), section("C", F.col("c_mktsegment")))
    default = keywords.claim_default(F.lit("home_appliances"), claim, claim, F.lit("n"), F.col("c_mktsegment"), F.col("c_custkey"))
    return t(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), text.first_non_blank(claim, "c_mktsegment").alias("first_full"), text.shortened(F.col("c_name"), 10).alias("short"), patent.outline(sections).alias("outline"),
        keywords.valid_input(F.lit("general"), claim, F.lit("1"), F.lit("")).alias("general"), keywords.valid_input(F.lit("fitness"), claim, F.lit("1"), F.lit("x")).alias("fitness"), default["claim_id"].alias("claim_id"),
        rules.claim_kind(F.when(even, "独立权利要求").otherwise("dependent")).alias("kind"),
    )


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'txt' END AS format, CASE WHEN page_id % 2 = 0 THEN html ELSE repeat('b', 60) END AS usable, sha256(html) AS file_sha256, length(url) AS url_length FROM pages")
def q_files(spark, d):
    """Formats of urls, the first usable text, digests, texts cut to their columns."""
    i = F.col("page_id")
    url = F.when(i % 3 == 0, "http://x/a.PDF?q=1").when(i % 3 == 1, "http://x/get?file_path=b.docx").otherwise("http://x/get")
    usable = files.first_usable(F.when(i % 2 == 0, F.col("html")).otherwise("[error] " + "x" * 60), F.repeat(F.lit("b"), F.lit(60)))
    rows = t(spark, d, "pages").select("page_id", "url", files.file_format(url, F.lit("text")).alias("format"), usable.alias("usable"), F.lit("t 1").alias("task_id"), F.lit("图 1.png").alias("name"), F.col("html").cast("binary").alias("content"), F.col("url").alias("page_url"))
    out = lifecycle.error_reports(sinks.figure_files(rows, "http://b"))
    return out.select("page_id", "format", "usable", "file_sha256", F.length("page_url").alias("url_length"))


@query("""WITH x AS (SELECT * FROM conversations WHERE regexp_matches(text, '[^\\s\\p{Z}]')) SELECT conv_id AS path, string_agg(text, chr(10) ORDER BY turn) AS raw_text, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS ocr_text FROM x GROUP BY 1""")
def q_page_text(spark, d):
    """Turns as pages of a reader, joined in order, and as pages of character recognition."""
    pages = t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("page"), "text")
    return files.page_text(pages).join(files.page_text(pages, glue=files.OCR_GLUE).withColumnRenamed("raw_text", "ocr_text"), "path")


@query("SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS own, sum(CASE WHEN user_id = 7 THEN 1 ELSE 0 END)::BIGINT AS seven FROM events GROUP BY 1")
def q_scopes(spark, d):
    """Rows that a user, an administrator and a session see."""
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("analysis_session_id"), F.col("user_id").alias("id"))
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    every = count(lookup.visible(rows, "7", admin=True), "n").join(count(lookup.scoped(rows, "view"), "own"), "id", "left").join(count(lookup.visible(rows, "7", admin=False), "seven"), "id", "left")
    return every.select("id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("seven", F.lit(0)).alias("seven"))


@query("SELECT o_custkey AS session_id, arg_max(o_orderpriority, o_orderkey) AS priority, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS status FROM orders GROUP BY 1")
def q_merged_results(spark, d):
    """Result maps merged in order; later keys win, null never replaces a value."""
    results = F.map_from_arrays(F.array(F.lit("priority"), F.lit("status")), F.array(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), results.alias("results"))
    return lifecycle.merged_results(rows).select("session_id", F.col("results")["priority"].alias("priority"), F.col("results")["status"].alias("status"))


@query("SELECT p_partkey AS product_id, true AS has_payload, 0 AS n_pictures, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part")
def q_stored_products(spark, d):
    """K3, K4: empty texts become null; a row without payload keeps itself as JSON."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), F.lit(None).cast("array<string>").alias("picture"), F.lit(None).cast("string").alias("raw_payload"))
    out = sinks.empty_to_null(sinks.stored_product(rows))
    return out.select("product_id", (F.get_json_object("raw_payload", "$.product_id") == F.col("product_id").cast("string")).alias("has_payload"), F.size("picture").alias("n_pictures"), "brand")
