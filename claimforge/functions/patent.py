"""Patent text to structure: metadata, sections, claims, features, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import WS, distinct_by, let, no_ws, strip, strip_chars

# Fixed values that results depend on.
HEADINGS = {
    "技术领域": ("技术领域",),
    "背景技术": ("背景技术",),
    "发明内容": ("发明内容", "发明概述", "发明的内容"),
    "实用新型内容": ("实用新型内容",),
    "附图说明": ("附图说明", "说明书附图"),
    "具体实施方式": ("具体实施方式", "具体实施例", "实施方式"),
}
CLAIM_ENDS = ("说明书全文", "说明书", "摘要", "技术领域", "背景技术", "发明内容", "实用新型内容", "附图说明")
FEATURE_STARTS = ("所述", "第一", "第二", "第三", "第四", "主体", "平支架", "侧支架", "电池", "联接", "防水", "驱动机构", "集雪组件", "抛雪机构", "控制机构", "I/O端口", "颈带线")
FEATURE_LEADS = ("和", "及", "以及", "并且", "并", "其中", "进一步包括")
TRIM = " ，,;；。"
GOODS = ("扫地机器人", "平衡车", "扫地机", "洗地机", "吸尘器", "无人机", "摄像头", "门锁", "充电桩", "投影仪", "打印机", "净化器", "咖啡机", "路由器", "显示器", "耳机", "机器人")
SUBJECT_ENDS = ("控制方法", "控制系统", "方法", "系统", "装置", "设备", "结构", "组件", "模组", "机构")
GENERIC_ENDS = "机器车锁柜箱仪刷灯镜表杆架轮"
NOISE = ("专利分析", "专利", "分析", "示例", "样例", "demo", "test", "测试", "上传")
HAN = r"\x{4e00}-\x{9fa5}"

_DATE = r"\d{4}[./-]\d{2}[./-]\d{2}"
_HEADING = rf"(?m)^{WS}*(?:{'|'.join(a for v in HEADINGS.values() for a in v)}){WS}*$"


def _loose(word: str) -> str:
    """The word with white space allowed between its characters."""
    return f"{WS}*".join(word)


def metadata(text: Column) -> Column:
    """Struct of number, application date, priority date, title and holder, from bracket codes; null where absent."""
    got = lambda pattern: F.nullif(strip(F.regexp_extract(text, pattern, 1)), F.lit(""))
    date = lambda c: F.translate(c, "./", "--")
    joined = lambda c: F.regexp_replace(c, rf"{WS}*\n{WS}*", "")
    priority = got(rf"\(30\){WS}*优先权数据{WS}*\n?{WS}*([^\n]+)")
    return F.struct(
        got(rf"\(21\){WS}*申请号{WS}+([A-Z0-9.\-/,]+)").alias("patent_number"),
        date(got(rf"\(22\){WS}*申请日{WS}+({_DATE})")).alias("application_date"),
        date(F.nullif(F.regexp_extract(priority, f"({_DATE})", 1), F.lit(""))).alias("priority_date"),
        joined(got(rf"(?s)\(54\){WS}*发明名称{WS}*\n?{WS}*(.*?)(?=\n{WS}*\(57\)|\n{WS}*摘要)")).alias("title"),
        joined(got(rf"(?s)\(73\){WS}*专利权人{WS}+(.*?)(?=\n{WS}*地址|\n{WS}*\(72\)|\n{WS}*\(74\))")).alias("holder"),
    )


def canonical_heading(alias: Column) -> Column:
    """X3."""
    return F.coalesce(*(F.when(alias.isin(*names), name) for name, names in HEADINGS.items()), alias)


def sections(df: DataFrame, key: str = "task_id", text: str = "raw_text") -> DataFrame:
    """Key, seq, section_name, section_text, start_position, end_position (0-based, unstripped bounds).

    The text is cut before every heading line; offsets are running sums of the pieces' lengths, one
    window per document."""
    pieces = df.select(key, F.posexplode(F.split(F.col(text), f"(?={_HEADING})")).alias("piece", "body"))
    in_doc = Window.partitionBy(key).orderBy("piece")
    head = F.regexp_extract("body", f"({_HEADING})", 1)
    placed = pieces.withColumn("end_position", F.sum(F.length("body")).over(in_doc).cast("int")).withColumn("head", head)
    found = placed.filter(F.length("head") > 0).withColumn("own", F.substr("body", F.length("head") + 1)).filter(strip("own") != "")
    return found.select(
        key,
        F.row_number().over(in_doc).alias("seq"),
        canonical_heading(strip("head")).alias("section_name"),
        strip("own").alias("section_text"),
        (F.col("end_position") - F.length("own")).alias("start_position"),
        "end_position",
    )


def claims_block(text: Column) -> Column:
    """What follows a claims heading up to the next heading of the description. The first candidate
    of 200 characters or more with a line that begins with claim 1, else the longest (the first of equals)."""
    opening = rf"(?:{_loose('权利要求书')}|{_loose('权利要求')})"
    stop = "|".join(_loose(w) for w in CLAIM_ENDS)
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s){opening}(?U:[：:\s])*(.*?)(?=(?:{WS}*(?:{stop}))|\z)"), F.lit(1)), strip)
    candidates = F.filter(found, lambda c: c != "")
    first = F.get(F.filter(candidates, lambda c: (F.length(c) >= 200) & c.rlike(rf"(?m)^{WS}*1{WS}*[.、:：]")), F.lit(0))
    longest = F.get(F.filter(candidates, lambda c: F.length(c) == F.array_max(F.transform(candidates, F.length))), F.lit(0))
    return F.coalesce(first, longest)


_CLAIM = rf"(?m)^{WS}*(?:权利要求)?(\d+(?:\.\d+)?){WS}*[.、:：]{WS}*"


def sentence_units(text: Column) -> Column:
    """Parts ended by 。 and then by ；, stripped, without bare marks; the whole text if there is none."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("([^。]+。?)"), F.lit(1)), lambda u: F.regexp_extract_all(strip(u), F.lit("([^；]+；?)"), F.lit(1))))
    kept = F.filter(F.transform(parts, strip), lambda x: ~x.isin("", "；", "。"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def claims(df: DataFrame, key: str = "task_id", text: str = "claims_text") -> DataFrame:
    """Key, seq, claim_id, claim_type, claim_text, parent_claim_id, sentence_units."""
    heads = df.select(key, F.posexplode(F.split(F.col(text), f"(?={_CLAIM})")).alias("seq", "body"))
    number = F.regexp_extract("body", _CLAIM, 1)
    body = strip(F.regexp_replace("body", rf"\A{_CLAIM}", ""))
    parent = F.nullif(F.regexp_extract("claim_text", rf"(?:{_loose('根据')}|如|{_loose('引用')}){WS}*{_loose('权利要求')}{WS}*(\d+)", 1), F.lit(""))
    split = heads.filter(number != "").select(key, "seq", number.alias("claim_id"), body.alias("claim_text")).withColumn("parent_claim_id", parent)
    kind = F.when(F.col("parent_claim_id").isNull(), "INDEPENDENT").otherwise("DEPENDENT")
    return split.select(key, "seq", "claim_id", kind.alias("claim_type"), "claim_text", "parent_claim_id", sentence_units(F.col("claim_text")).alias("sentence_units"))


def claim_errors(block: Column) -> Column:
    """Error structs of a claims block."""
    error = lambda kind, message: F.struct(F.lit(kind).alias("error_type"), F.lit(message).alias("error_message"), F.lit("claims").alias("affected_section"), F.lit(True).alias("is_recoverable"))
    text = F.coalesce(block, F.lit(""))
    return F.array_compact(F.array(F.when(F.length(strip(text)) < 10, error("CLAIMS_PARSE_ERROR", "claims block too short")), F.when(~text.rlike(_CLAIM), error("CLAIMS_NUMBERING_ERROR", "no numbered claims"))))


def claim_depth(claims_df: DataFrame, key: str = "task_id") -> DataFrame:
    """X11 (extension): depth of every claim in its dependency tree, by doubling over parents until no claim
    has a parent left; a missing parent ends the way up, and a claim whose way ends in a cycle has no depth."""
    from ..sources.shared import cut

    up = cut(claims_df.select(key, "claim_id", F.col("parent_claim_id").alias("at"), F.when(F.col("parent_claim_id").isNull(), 0).otherwise(1).alias("depth")))
    # No way without a cycle is longer than the claims of its key are many.
    most = up.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step <= most and not up.filter("at is not null").isEmpty():
        far = up.select(F.col(key).alias("f_key"), F.col("claim_id").alias("f_id"), F.col("at").alias("f_at"), F.col("depth").alias("f_depth"))
        up = cut(up.join(far, (F.col(key) == F.col("f_key")) & (F.col("at") == F.col("f_id")), "left").select(key, "claim_id", F.col("f_at").alias("at"), (F.col("depth") + F.coalesce("f_depth", F.lit(0))).alias("depth")))
        step *= 2
    return up.select(key, "claim_id", F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def features(claim_id: Column, text: Column) -> Column:
    """Array of (feature_id, feature_text, claim_id), at most 26."""

    def pieces(flat: Column) -> Column:
        including = r"^(.*?)(?:[,，]?(?U:\s)*其特征在于[,，:]?(?U:\s)*)?(?:包括|包含)[:：]?(?U:\s)*(.*)$"
        has = flat.rlike(including)
        lead = F.when(has, strip_chars(F.regexp_extract(flat, including, 1), TRIM)).otherwise("")
        rest = F.when(has, strip(F.regexp_extract(flat, including, 2))).otherwise(strip(F.regexp_replace(flat, r"^[,，]?(?U:\s)*其特征在于[:：]?(?U:\s)*", "")))
        clean = lambda items: F.filter(F.transform(items, lambda x: strip_chars(x, TRIM)), lambda x: x != "")

        def parts(rest: Column) -> Column:
            by_mark = clean(F.split(rest, "[;\n]+"))
            return F.when(F.size(by_mark) > 1, by_mark).otherwise(clean(F.split(rest, f"，(?={'|'.join(FEATURE_STARTS)})")))

        bare = lambda x: strip_chars(F.regexp_replace(x, rf"^(?:{'|'.join(FEATURE_LEADS)})(?U:[:：,，]?\s*)", ""), TRIM)
        listed = F.concat(F.array(lead), F.transform(let(rest, parts), bare))
        return F.slice(F.array_distinct(F.filter(listed, lambda x: x != "")), 1, 26)

    flat = F.translate(strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")), "；：", ";:")
    return F.transform(let(flat, pieces), lambda x, i: F.struct(F.concat(claim_id, F.chr(i + 65)).alias("feature_id"), x.alias("feature_text"), claim_id.alias("claim_id")))


def figure_labels(text: Column) -> Column:
    """Distinct figure labels in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"图{WS}*(\d+)"), F.lit(1)), lambda x: F.concat(F.lit("图"), x)))


def figure_descriptions(sections_df: DataFrame, key: str = "task_id") -> DataFrame:
    """Key, figure_id, description; a later description of a figure replaces an earlier one."""
    text = F.regexp_replace(F.regexp_replace("section_text", '[”"]', ""), r"图[\]lI]", "图1")
    group = rf"((?:图{WS}*\d+{WS}*(?:和|及|以及|、|,|，)?{WS}*)+){WS}*[是为：:]{WS}*([^\n]+)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(group), F.lit(1)).alias("ids"), F.regexp_extract_all(text, F.lit(group), F.lit(2)).alias("said"))
    rows = sections_df.filter(F.contains("section_name", F.lit("附图说明"))).select(key, "seq", F.posexplode(both).alias("line", "v"))
    told = rows.select(key, "seq", "line", strip_chars(strip(F.col("v.said")), "，,；;。").alias("description"), F.explode(F.regexp_extract_all("v.ids", F.lit(rf"(图{WS}*\d+)"), F.lit(1))).alias("figure"))
    return told.filter(F.col("description") != "").groupBy(key, no_ws("figure").alias("figure_id")).agg(F.max_by("description", F.struct("seq", "line")).alias("description"))


def figure_page(pages: DataFrame, key: str = "doc") -> DataFrame:
    """Adds n_text, anchor (first page with 附图说明, white space aside), explicit (with 说明书附图)
    and is_figure to (key, page, text, images, drawings)."""
    doc = Window.partitionBy(key)
    counted = pages.withColumn("flat", no_ws(F.coalesce("text", F.lit(""))))
    counted = counted.withColumn("n_text", F.length("flat")).withColumn("told", F.contains("flat", F.lit("附图说明"))).withColumn("explicit", F.contains("flat", F.lit("说明书附图")))
    counted = counted.withColumn("anchor", F.min(F.when(F.col("told"), F.col("page"))).over(doc))
    after = F.coalesce(F.col("page") > F.col("anchor"), F.lit(False))
    labels, drawn, held = F.size(figure_labels(F.coalesce("text", F.lit("")))) > 0, F.col("drawings"), F.col("images") > 0
    rule = F.col("explicit") | (labels & (F.col("n_text") <= 120)) | (after & (F.col("n_text") <= 120)) | (after & (drawn >= 10) & (F.col("n_text") <= 600)) | ((drawn >= 20) & (F.col("n_text") <= 400)) | (held & (drawn > 0) & (F.col("n_text") <= 200))
    return counted.withColumn("is_figure", F.coalesce(rule, F.lit(False))).drop("flat")


def trailing_pages(pages: DataFrame, key: str = "doc") -> DataFrame:
    """The last run of pages with 40 characters or fewer and any graphics, as gaps and islands."""
    ok = (F.length(no_ws("text")) <= 40) & ((F.col("images") > 0) | (F.col("drawings") > 0))
    by_page = Window.partitionBy(key).orderBy("page")
    hits = pages.withColumn("place", F.row_number().over(by_page)).filter(ok)
    runs = hits.withColumn("run", F.col("place") - F.row_number().over(by_page))
    return runs.withColumn("last", F.max("run").over(Window.partitionBy(key))).filter("run = last").select(key, "page")


def candidate_pages(pages: DataFrame, described: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """Key and pages by the first rule that gives any: explicit figure pages; as many trailing image
    pages as figures are described, if there are so many; classified pages (after the anchor if there
    is one); all pages after the anchor; as many last pages as figures are described.

    described: (key, n), the number of described figures; none if left out."""
    marked = figure_page(pages, key).withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("page"))))
    tail = trailing_pages(pages, key).select(F.col(key).alias("t_key"), F.col("page").alias("t_page"))
    joined = marked.join(tail, (F.col(key) == F.col("t_key")) & (F.col("page") == F.col("t_page")), "left")
    if described is None:
        joined = joined.withColumn("n", F.lit(0))
    else:
        joined = joined.join(described.select(F.col(key).alias("n_key"), "n"), F.col(key) == F.col("n_key"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("page"))))
    after = F.col("page") > F.col("anchor")
    classified = F.col("is_figure") & ~F.col("told") & F.coalesce(after, F.lit(True))
    lists = joined.groupBy(key).agg(F.max("n").alias("n"), some(F.col("explicit")).alias("a"), some(F.col("t_page").isNotNull()).alias("b"), some(classified).alias("c"), some(after).alias("d"), some(F.col("from_end") <= F.col("n")).alias("e"))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    n = F.col("n").cast("int")
    trailing = F.when((n > 0) & (F.size("b") >= n), F.slice("b", F.size("b") - n + 1, n))
    return lists.select(key, F.coalesce(filled("a"), trailing, *map(filled, "cde"), F.array().cast("array<int>")).alias("pages"))


def figure_ids(labels: Column, described: Column | None = None, existing: Column | None = None) -> Column:
    """Figure identities of a document's pages, from the array of each page's labels: the first label not
    yet used, else the first described figure not yet used, else the next number. A fold over the pages of
    one document; existing are identities used before, which the numbers go on from."""
    none = F.array().cast("array<string>")
    described, existing = (none if c is None else c for c in (described, existing))
    start = F.struct(none.alias("out"), existing.alias("used"), F.filter(described, lambda x: ~F.array_contains(existing, x)).alias("left"), (F.size(existing) + 1).alias("next"))

    def step(state: Column, page: Column) -> Column:
        unused = F.filter(page, lambda x: ~F.array_contains(state["used"], x))
        name = F.coalesce(F.get(unused, F.lit(0)), F.get(state["left"], F.lit(0)), F.concat(F.lit("图"), state["next"].cast("string")))
        return F.struct(F.array_append(state["out"], name).alias("out"), F.array_append(state["used"], name).alias("used"), F.filter(state["left"], lambda x: x != name).alias("left"), (state["next"] + 1).alias("next"))

    return F.aggregate(labels, start, step, lambda s: s["out"])


def image_urls(text: Column) -> Column:
    """Img sources, then bare http URLs with an image suffix; duplicates kept."""
    tags = F.regexp_extract_all(text, F.lit(r"""(?i)<img[^>]+src=["'](https?://[^"']+)["']"""), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"""(?i)(https?://[^\s"'<>]+\.(?:png|jpe?g|gif|bmp|webp))"""), F.lit(1))
    return F.concat(tags, bare)


def patent_number(text: Column) -> Column:
    """A publication number (spaces removed, upper case), else an application number, else null."""
    edge = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")
    publication = F.regexp_extract(text, rf"(?i){edge[0]}(CN(?U:\s)*\d{{6,12}}(?:\.\d)?[A-Z]){edge[1]}", 1)
    application = F.regexp_extract(text, rf"{edge[0]}(\d{{8,12}}\.\d){edge[1]}", 1)
    return F.coalesce(F.nullif(F.upper(no_ws(publication)), F.lit("")), F.nullif(application, F.lit("")))


def subject(source: Column) -> Column:
    """What a title or file name is about: named goods, then objects of methods and devices (the
    longest match of a tier), then generic goods, then the first Chinese words."""
    edge = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")
    bare = F.regexp_replace(source, r"(?i)\.[a-z0-9]+$", "")
    for pattern in (rf"(?i){edge[0]}CN(?U:\s)*\d{{6,12}}(?:\.\d)?[A-Z]{edge[1]}", rf"{edge[0]}\d{{8,12}}\.\d{edge[1]}", r"[【】\[\]（）()]", "[_-]+", f"(?i){'|'.join(NOISE)}"):
        bare = F.regexp_replace(bare, pattern, " ")

    def pick(text: Column) -> Column:
        def tier(pattern: str) -> Column:
            found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip), lambda x: F.length(x) >= 2)
            return let(found, lambda f: F.get(F.filter(f, lambda x: F.length(x) == F.array_max(F.transform(f, F.length))), F.lit(0)))

        generic = F.nullif(F.regexp_extract(text, rf"([{HAN}]{{2,20}}[{GENERIC_ENDS}])", 1), F.lit(""))
        plain = F.nullif(F.regexp_extract(text, rf"([{HAN}]{{2,12}})", 1), F.lit(""))
        return F.coalesce(tier(rf"([{HAN}A-Za-z0-9]{{2,20}}?(?:{'|'.join(GOODS)}))"), tier(rf"(?:一种|用于|涉及|关于)?([{HAN}]{{2,20}}?)(?:{'|'.join(SUBJECT_ENDS)})"), generic, plain)

    return let(strip(F.regexp_replace(bare, f"{WS}+", " ")), pick)


def session_title(titles: list[Column], sources: list[Column]) -> Column:
    """The first subject among titles and sources, in order, as the title of its analysis; without one the first title, else the bare word."""
    found = F.coalesce(*(F.nullif(subject(c), F.lit("")) for c in (*titles, *sources)))
    return F.coalesce(F.concat(found, F.lit("专利分析")), *(F.nullif(strip(c), F.lit("")) for c in titles), F.lit("专利分析"))


def app_token(url: Column) -> Column:
    """The token after /base/ or /wiki/, or a bare token of 20 characters or more."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/base/([A-Za-z0-9]+)", r"/wiki/([A-Za-z0-9]+)", r"^([A-Za-z0-9]{20,})$")))


def distinct_features(items: Column) -> Column:
    """D8."""
    return distinct_by(items, strip)


def outline(sections_array: Column) -> Column:
    """Name and text of each section, blank ones skipped, a blank line between."""
    return F.array_join(F.transform(F.filter(sections_array, lambda s: strip(s["section_text"]) != ""), lambda s: F.concat_ws("\n", s["section_name"], s["section_text"])), "\n\n")


def section_of(sections_array: Column, *words: str) -> Column:
    """Text of the first section whose lower-cased name contains one of the words; else empty."""
    hit = F.filter(sections_array, lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s["section_name"]), w)))
    return F.coalesce(F.get(hit, F.lit(0))["section_text"], F.lit(""))
