"""What external models are asked for, checked when it comes in: structure, claims and analysis replies (2.15; J7, J8, X5, X6, Q9, A1).

Each reply is decoded once and written to the shared folder; accepted rows and rejects are two views of that, and their counts are
observed on the way. A reply that breaks its contract is replaced as a whole by what the text's own rules give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import patent, replies
from ..functions.replies import VARIANTS, field, is_object, is_text
from ..functions.rules import MISSING_TYPE, rule_result
from ..functions.text import strip
from ..sources.shared import written
from . import assembly

CLAIM_TYPES = ("INDEPENDENT", "DEPENDENT")
CLAIM = "claim_id string, claim_type string, claim_text string, parent_claim_id string, sentence_units array<string>"
METADATA = ("patent_number", "application_date", "priority_date", "patent_holder", "title")
# Reasons of features that a reply says nothing of.
LEFT_OUT, NOT_A_LIST = "LLM未返回该特征的分析结果", "大模型返回格式异常，无法解析"


@dataclass
class Decoded:
    """accepted: rows with their origin; rejects: key, seq, reason, payload; counts: accepted and rejected items of the replies."""

    accepted: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def _text_or(item: Column, name: str, default: str | None) -> Column:
    """A field as text; the default if it isn't there."""
    found = field(item, name)
    return F.when(found.isNull(), F.lit(default)).otherwise(F.try_variant_get(found, "$", "string"))


def _decoded(df: DataFrame, what: str, items: Column, rejects: Column, key: str, *more: str) -> tuple[DataFrame, dict[str, int]]:
    """key, items, rejects and more of each reply, written once, and the observed counts."""
    seen = Observation(what)
    counted = df.select(key, *more, items.alias("items"), rejects.alias("rejects")).observe(seen, F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.size("rejects")), F.lit(0)).alias("rejected"))
    return written(counted, what), seen.get


def _rejects(decoded: DataFrame, key: str) -> DataFrame:
    return decoded.select(key, F.explode("rejects").alias("r")).select(key, "r.seq", "r.reason", "r.payload")


def _reject(seq: Column, reason: Column, payload: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), reason.alias("reason"), payload.alias("payload"))


NO_REJECTS = "array<struct<seq:int,reason:string,payload:string>>"


def claims_reply(df: DataFrame, key: str = "task_id", reply: str = "reply", text: str = "claims_text") -> Decoded:
    """Claims of replies {"claims": [{claim_id, claim_type, claim_text, parent_claim_id, sentence_units}]}, else those that X6 finds in the
    claims' text.

    Missing fields have defaults. A reply whose {..} doesn't parse, or with a type out of the enum, a text or parent that is no text,
    or units that aren't a list of texts, is rejected whole. A reply without {..} has no claims. Items that aren't objects are passed over."""
    body = replies.braced(F.col(reply))
    v = F.try_parse_json(body)
    items = F.filter(F.coalesce(F.try_variant_get(field(v, "claims"), "$", VARIANTS), F.array().cast(VARIANTS)), is_object)

    def read(x: Column, i: Column) -> Column:
        kind, said, parent, units = (field(x, n) for n in ("claim_type", "claim_text", "parent_claim_id", "sentence_units"))
        listed = F.try_variant_get(units, "$", VARIANTS)
        problem = (
            F.when(kind.isNotNull() & ~F.coalesce(F.try_variant_get(kind, "$", "string").isin(*CLAIM_TYPES), F.lit(False)), "claim_type")
            .when(said.isNotNull() & ~is_text(said), "claim_text")
            .when(parent.isNotNull() & ~F.is_variant_null(parent) & ~is_text(parent), "parent_claim_id")
            .when(units.isNotNull() & ~F.coalesce(F.forall(listed, is_text), F.lit(False)), "sentence_units")
        )
        claim = F.struct(i.cast("int").alias("seq"), _text_or(x, "claim_id", "").alias("claim_id"), _text_or(x, "claim_type", "INDEPENDENT").alias("claim_type"), _text_or(x, "claim_text", "").alias("claim_text"), F.try_variant_get(parent, "$", "string").alias("parent_claim_id"), F.coalesce(F.try_variant_get(units, "$", "array<string>"), F.array().cast("array<string>")).alias("sentence_units"))
        return F.struct(claim.alias("claim"), problem.alias("problem"), F.to_json(x).alias("payload"))

    parsed = df.withColumn("_cf_read", F.transform(items, read))
    bad = F.transform(F.filter("_cf_read", lambda r: r["problem"].isNotNull()), lambda r: _reject(r["claim"]["seq"], r["problem"], r["payload"]))
    rejects = F.when(body.isNotNull() & v.isNull(), F.array(_reject(F.lit(None), F.lit("NOT_JSON"), body))).otherwise(bad)
    good = F.when(F.size(rejects) > 0, F.slice(F.transform("_cf_read", lambda r: r["claim"]), 1, 0)).otherwise(F.transform("_cf_read", lambda r: r["claim"]))
    decoded, counts = _decoded(parsed, "claims", good, rejects, key, text)
    own = decoded.select(key, F.explode("items").alias("c"), F.lit("reply").alias("origin")).select(key, "c.*", "origin")
    ruled = patent.claims(decoded.filter(F.size("rejects") > 0).select(key, text), key, text).withColumn("origin", F.lit("rules"))
    return Decoded(own.unionByName(ruled), _rejects(decoded, key), counts)


def structure_reply(df: DataFrame, key: str = "task_id") -> Decoded:
    """Sections, claims text and metadata of replies {"sections": [{name, text}], "claims_section", "metadata"}.

    df has key, reply, raw_text, fallback_sections (array of section_name, section_text), fallback_claims, and structs cn_metadata and
    fallback_metadata. Sections get their place in the raw text (X5); fallback sections of other names follow (J8); metadata
    fields fall through reply, codes and fallback (J7). A {..} that doesn't parse, sections that aren't a list, or a name or text in
    them that is no text, rejects the reply, and the fallbacks stand alone. A reply without {..} has no sections."""
    body = replies.braced(F.col("reply"))
    v = F.try_parse_json(body)
    held = field(v, "sections")
    items = F.filter(F.when(held.isNull(), F.array().cast(VARIANTS)).otherwise(F.try_variant_get(held, "$", VARIANTS)), is_object)
    wrong = lambda x, n: field(x, n).isNotNull() & ~is_text(field(x, n))
    reason = F.when(body.isNotNull() & v.isNull(), "NOT_JSON").when(v.isNotNull() & items.isNull(), "sections").when(F.exists(items, lambda x: wrong(x, "name")), "name").when(F.exists(items, lambda x: wrong(x, "text")), "text")
    placed = lambda name, text: F.struct(name.alias("section_name"), text.alias("section_text"), *(assembly.offsets(F.col("raw_text"), text)[c].cast("int").alias(c) for c in ("start_position", "end_position")))
    own = F.transform(items, lambda x: placed(_text_or(x, "name", ""), _text_or(x, "text", "")))
    back = F.transform("fallback_sections", lambda s: placed(s["section_name"], s["section_text"]))
    rest = F.filter(back, lambda s: ~F.exists(own, lambda o: o["section_name"] == s["section_name"]))
    said = F.struct(*(F.try_variant_get(v, f"$.metadata.{n}", "string").alias(n) for n in METADATA))
    claims = F.nullif(F.try_variant_get(v, "$.claims_section", "string"), F.lit(""))
    fields = F.struct(
        F.when(reason.isNotNull(), back).when(v.isNull(), F.slice(back, 1, 0)).otherwise(F.concat(own, rest)).alias("sections"),
        F.when(reason.isNotNull(), F.col("fallback_claims")).when(v.isNull(), "").otherwise(F.coalesce(claims, F.col("fallback_claims"), F.lit(""))).alias("claims_section"),
        F.when(reason.isNotNull(), assembly.filled(F.col("cn_metadata"), F.col("fallback_metadata"), fields=METADATA)).when(v.isNotNull(), assembly.filled(said, F.col("cn_metadata"), F.col("fallback_metadata"), fields=METADATA)).alias("metadata"),
        F.when(reason.isNotNull(), "rules").otherwise("reply").alias("origin"),
    )
    rejects = F.when(reason.isNotNull(), F.array(_reject(F.lit(None), reason, body))).otherwise(F.array().cast(NO_REJECTS))
    decoded, counts = _decoded(df, "structure", F.array(fields), rejects, key)
    return Decoded(decoded.select(key, F.explode("items").alias("s")).select(key, "s.*"), _rejects(decoded, key), counts)


def analysis_reply(df: DataFrame, key: str = "task_id") -> Decoded:
    """Q9, A1: analysed features of replies {"analysis": [{feature_id, evidence, reason, reasoning_type, claim_id, evidence_images}]} with
    their results.

    df has key, reply and features (array of feature_id, claim_id). Items without a feature_id are rejected. Features that the reply
    leaves out follow with the missing type, all of them if it has no list. Images are the non-blank texts of their list."""
    text = F.col("reply")
    fenced = F.try_parse_json(strip(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?(?U:\s*)(.*?)```", 1), F.lit(""))))
    v = F.coalesce(fenced, F.try_parse_json(strip(text)), F.try_parse_json(replies.bracketed(text)), F.parse_json(F.lit("[]")))
    items = F.try_variant_get(F.when(is_object(v) & field(v, "analysis").isNotNull(), field(v, "analysis")).otherwise(v), "$", VARIANTS)

    def row(feature, claim, evidence, reason, kind, images, origin) -> Column:
        return F.struct(feature.alias("feature_id"), claim.alias("claim_id"), evidence.alias("evidence"), reason.alias("reason"), kind.alias("reasoning_type"), images.alias("evidence_images"), F.lit(origin).alias("origin"))

    none = F.array().cast("array<string>")
    named = lambda x: F.coalesce(is_object(x) & (F.coalesce(_text_or(x, "feature_id", ""), F.lit("")) != ""), F.lit(False))
    full = lambda x, n, default="": F.coalesce(_text_or(x, n, default), F.lit(""))
    pictures = lambda x: F.coalesce(F.transform(F.filter(F.try_variant_get(field(x, "evidence_images"), "$", VARIANTS), lambda i: is_text(i) & (strip(F.try_variant_get(i, "$", "string")) != "")), lambda i: F.try_variant_get(i, "$", "string")), none)
    own = F.transform(F.filter(items, named), lambda x: row(full(x, "feature_id"), full(x, "claim_id"), full(x, "evidence"), full(x, "reason"), full(x, "reasoning_type", MISSING_TYPE), pictures(x), "reply"))
    rejects = F.transform(F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~named(p["x"])), lambda p: _reject(p["i"], F.when(is_object(p["x"]), "feature_id").otherwise("NOT_AN_OBJECT"), F.to_json(F.array(p["x"]))))
    blank = F.lit("")
    filled = lambda features, reason, origin: F.transform(features, lambda f: row(f["feature_id"], f["claim_id"], blank, F.lit(reason), F.lit(MISSING_TYPE), none, origin))
    left = F.filter("features", lambda f: ~F.exists(own, lambda o: o["feature_id"] == f["feature_id"]))
    rows = F.when(items.isNull(), filled(F.col("features"), NOT_A_LIST, "format")).otherwise(F.concat(own, filled(left, LEFT_OUT, "missing")))
    decoded, counts = _decoded(df, "analysis", rows, F.when(items.isNull(), F.array(_reject(F.lit(None), F.lit("NOT_A_LIST"), F.to_json(v)))).otherwise(rejects), key)
    out = decoded.select(key, F.posexplode("items").alias("seq", "a")).select(key, "seq", "a.*")
    return Decoded(out.withColumn("comparison_result", rule_result(F.col("reasoning_type"), F.col("reason"))), _rejects(decoded, key), counts)
