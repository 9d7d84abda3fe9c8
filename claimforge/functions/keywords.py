"""Search keywords: holder names, guardrails and display types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, contains_any, guard_norm, strip, strip_chars

# Fixed values that results depend on.
LEGALISTIC = ("用于", "具备", "关于", "相关", "本体", "装置")
ENTERPRISE = ("公司", "集团", "有限", "股份", "企业", "实业", "科技", "技术", "工业", "电子", "株式会社", "会社", "LLC", "INC", "CORP", "CORPORATION", "LTD", "LIMITED", "GMBH")
SUFFIXES = (r"(股份)?有限公司$", r"有限责任公司$", r"股份公司$", r"集团有限公司$", r"集团公司$", r"科技有限公司$", r"技术有限公司$", r"电子有限公司$", r"实业有限公司$", r"公司$", r"集团$", r"企业$", r"株式会社$", r"会社$", r",?\s*INC\.?$", r",?\s*LLC$", r",?\s*LTD\.?$", r",?\s*LIMITED$", r",?\s*CORP\.?$", r",?\s*CORPORATION$", r",?\s*GMBH$")
EDGE = " ,，.。·"
#: Constants of the three keyword variants.
VARIANTS = {"general": "general", "home_appliances": "home_appliances", "fitness": "fitness_equipment"}


def is_enterprise(holder: Column) -> Column:
    """X44."""
    return contains_any(holder, ENTERPRISE) | contains_any(F.upper(holder), ENTERPRISE)


def holder_name(holder: Column) -> Column:
    """The holder without brackets and company suffixes; of a Latin name the first word; 12 characters."""
    name = strip(F.regexp_replace(F.translate(strip(F.coalesce(holder, F.lit(""))), "（）", "()"), r"\(.*?\)", ""))
    for pattern in SUFFIXES:
        name = strip(F.regexp_replace(name, f"(?i){pattern}", ""))
    name = strip_chars(name, EDGE)
    word = F.when(name.rlike("[A-Za-z]"), F.get(F.split(name, r"(?U:[\s,，]+)"), F.lit(0))).otherwise(name)
    return F.left(strip_chars(word, EDGE), F.lit(12))


def holder_keyword(holder: Column, primary: Column, search: Column, products: Column) -> Column:
    """Struct of the supplementary holder keyword, null if there is none."""
    objects = F.filter(F.transform(F.concat(search, products, F.array(primary)), strip), lambda x: x != "")
    chosen = F.coalesce(F.get(F.filter(objects, lambda x: ~contains_any(x, LEGALISTIC)), F.lit(0)), strip(primary), F.lit(""))
    name = holder_name(holder)
    made = F.struct(F.concat(name, F.lit("同款"), chosen).alias("keyword_text"), F.lit("holder_based").alias("keyword_type"), F.lit("品牌同款型-补充生成").alias("combination_pattern"), F.lit(0.88).alias("confidence"))
    return F.when(is_enterprise(holder) & (name != "") & (chosen != ""), made)


def breaks_guardrail(keyword: Column) -> Column:
    """Too short or long, with separators, legal wording in a long keyword, or a fragment said twice."""
    norm, text = guard_norm(keyword), strip(F.coalesce(keyword, F.lit("")))
    size = F.length(norm)
    return ~size.between(3, 18) | text.rlike("[、，,/]") | (contains_any(text, LEGALISTIC) & (size > 10)) | norm.rlike(r"(.{2,8})\1")


def display_type(kind: Column) -> Column:
    """J14."""
    return F.when(kind == "holder_based", "HOLDER_BASED").when(kind == "invention_based", "INVENTION_BASED").otherwise("COMBINED")


def valid_input(variant: Column, claim_text: Column, claim_id: Column, spec: Column) -> Column:
    """General takes a claim or any description; home_appliances a claim; fitness a claim with an id."""
    has = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    return F.when(variant == "general", has(claim_text) | has(spec)).when(variant == "fitness", has(claim_text) & has(claim_id)).otherwise(has(claim_text))


def claim_default(variant: Column, claim_id: Column, claim_text: Column, number: Column, invention: Column, seq: Column) -> Column:
    """Struct of claim_id and claim_text for a record without a claim."""
    none = F.coalesce(strip(claim_text) == "", F.lit(True))
    appliance = variant == "home_appliances"
    text = F.when(none, F.when(appliance, F.coalesce(invention, F.lit(""))).otherwise("")).otherwise(claim_text)
    own = F.nullif(strip(claim_id), F.lit(""))
    ident = F.coalesce(own, F.when(appliance, F.concat(F.lit("RECORD-"), seq.cast("string"))).otherwise(number))
    return F.struct(ident.alias("claim_id"), text.alias("claim_text"))


def numbering_removed(line: Column) -> Column:
    """A line without its leading number."""
    return strip(F.regexp_replace(line, rf"^{WS}*\d+(?U:[.、\s]+)", ""))
