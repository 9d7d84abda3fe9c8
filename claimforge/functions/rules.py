"""Rule classifications: statuses, reasoning types, industries, predicates on files and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, strip

# Fixed values that results depend on.
MATCH_TYPES = ("文字直接公开", "从图片中看出", "结合文字和图片毫无疑义得出", "根据功能推导得出")
NO_MATCH_TYPE = "可判断不具有"
MISSING_TYPE = "相关信息缺失"
ABSENCE = ("明确不包含", "明确不具有", "明确缺失", "不相同", "与该特征不同", "明确不存在", "明确没有", "与该特征相反")
STATUS_NO = ("不匹配", "不相同", "不同", "不一致", "区别", "no_match", "no-match", "no match", "not_match", "not-match", "not match")
STATUS_YES = ("匹配", "matching", "相同", "一致", "等同")
FITNESS = ("健身", "训练", "跑步机", "划船机", "椭圆机", "单车", "哑铃", "杠铃", "有氧", "力量", "运动器械", "treadmill", "rowing", "fitness")
APPLIANCE = ("家电", "家用电器", "洗衣机", "冰箱", "吸尘器", "空调", "空气净化", "电饭煲", "烹饪", "清洁", "厨房", "appliance", "vacuum", "refrigerator")
FILE_KINDS = {
    "image": "apng avif bmp gif heic ico jpg jpeg png svg tiff webp",
    "video": "mp4 avi mov mkv flv wmv webm m4v 3gp",
    "audio": "mp3 wav flac aac ogg wma m4a",
    "document": "pdf doc docx xls xlsx ppt pptx txt md csv json xml html htm",
}
TRANSPORT = ("fetch failed", "504", "超时", "timeout", "socket", "network", "aborted")
MISSING_CONTEXT = ("请提供需要拆解的独立权利要求", "请提供具体的专利技术特征列表", "请提供权利要求编号", "我需要您提供", "才能进行技术特征拆解", "我将为您进行技术特征拆解")
VERDICT_LABELS = {"infringement_likely": "疑似侵权", "no_infringement": "疑似不侵权", "uncertain": "需进一步分析"}
FAILURES = ("失败", "无比对结果", "无法进行比对")
TERMINAL = ("completed", "error", "cancelled", "timeout")


def rule_result(kind: Column, reason: Column) -> Column:
    """A1: reasoning type to MATCH, NO_MATCH or UNCERTAIN."""
    absent = (kind == MISSING_TYPE) & contains_any(reason, ABSENCE)
    return F.when(kind.isin(*MATCH_TYPES), "MATCH").when((kind == NO_MATCH_TYPE) | absent, "NO_MATCH").otherwise("UNCERTAIN")


def status(c: Column, compat: str | None = None) -> Column:
    """A3: free-form result to matching, not_matching or uncertain; misses are tested first.

    compat 'export' (A4) and 'bitable' (A5) are two older readings that take some misses for matches."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    if compat == "bitable":
        yes, no = contains_any(low, ("匹配", "match", "相同", "一致")), contains_any(low, ("不匹配", "not_match", "不同", "不一致"))
        return F.when(yes, "matching").when(no, "not_matching").otherwise("uncertain")
    if compat == "export":
        yes, no = contains_any(low, (*STATUS_YES, "match")), contains_any(low, ("不匹配", "not_match", "not matching", "不同", "不一致", "区别"))
        return F.when(no, "not_matching").when(yes, "matching").otherwise("uncertain")
    compact = F.regexp_replace(low, r"(?U:[\s_-])+", "")
    no = contains_any(low, STATUS_NO) | contains_any(compact, ("nomatch", "notmatch"))
    yes = contains_any(low, STATUS_YES) | low.rlike(r"(?<![a-z0-9_])match(?![a-z0-9_])")
    return F.when(no, "not_matching").when(yes, "matching").otherwise("uncertain")


def occurrences(text: Column, terms: tuple[str, ...]) -> Column:
    """Non-overlapping occurrences of each term, added up."""
    low, total = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for t in terms:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(t)))) / len(t)).cast("int")
    return total


def industry(text: Column, fitness: tuple[str, ...] = FITNESS, appliance: tuple[str, ...] = APPLIANCE) -> Column:
    """Struct of industry and confidence; no hits give general at 0.4, a tie goes to fitness."""
    f, a = occurrences(text, fitness), occurrences(text, appliance)
    kind = F.when((f == 0) & (a == 0), "general").when(f >= a, "fitness_equipment").otherwise("home_appliances")
    share = F.when((f == 0) & (a == 0), F.lit(0.4)).otherwise(F.round(F.greatest(f, a) / F.greatest(f + a, F.lit(1)), 2))
    return F.struct(kind.alias("industry"), share.alias("confidence"))


def file_kind(path: Column) -> Column:
    """Struct of category and extension with its dot (case kept); scheme, host, query and fragment are ignored."""
    name = F.substring_index(F.regexp_replace(F.regexp_replace(path, r"(?s)[?#].*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", ""), "/", -1)
    ext = F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)
    low, kind = F.lower(F.regexp_replace(ext, r"^\.", "")), F.lit("default")
    for category, names in FILE_KINDS.items():
        kind = F.when(low.isin(*names.split()), category).otherwise(kind)
    return F.struct(kind.alias("category"), ext.alias("extension"))


def image_mime(path: Column) -> Column:
    """X22."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.endswith(".gif"), "image/gif").when(low.endswith(".bmp"), "image/bmp").otherwise("image/png")


def image_kind(content_type: Column, content: Column) -> Column:
    """By content type, else by the first bytes."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.hex(F.substring(content, 1, 4))
    return F.when(F.contains(kind, F.lit("png")) | (head == "89504E47"), "png").when(F.contains(kind, F.lit("gif")) | head.startswith("474946"), "gif").when(kind.rlike("jpe?g") | head.startswith("FFD8"), "jpeg")


def recoverable(message: Column) -> Column:
    """J24."""
    return contains_any(F.lower(message), TRANSPORT)


def missing_context(reply: Column) -> Column:
    """X37."""
    return contains_any(reply, MISSING_CONTEXT)


def hints(message: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Advice for each substring that occurs, joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.contains(message, F.lit(k)), F.lit(v)) for k, v in table))), "；")


def flat_verdict(n: Column, n_match: Column, n_miss: Column) -> Column:
    """A6."""
    return F.when((n > 0) & (n_match == n), "infringement_likely").when((n_miss > 0) & (n_match == 0), "no_infringement").otherwise("uncertain")


def label(verdict: Column) -> Column:
    """Display label of a verdict."""
    return F.coalesce(*(F.when(verdict == k, v) for k, v in VERDICT_LABELS.items()), F.lit(VERDICT_LABELS["uncertain"]))


def claim_kind(kind: Column) -> Column:
    """J11."""
    return F.when(F.contains(kind, F.lit("独立")) | F.contains(F.upper(kind), F.lit("INDEPENDENT")), "INDEPENDENT").otherwise("DEPENDENT")
