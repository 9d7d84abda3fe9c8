"""Patent records to search keywords in one plan: the three variants differ by a column, not by copies of the plan.

records: record_id, variant (general, home_appliances, fitness), patent_number, patent_holder, technical_field,
background_tech, invention_content. claims: record_id, seq, claim_id, claim_type, claim_text. replies: record_id, seq (that of
the claim, null for a record without claims), stage (one of STAGES), attempt, reply; a later attempt replaces an earlier one.

What a variant changes:

* claims: general takes the primary one (W2), or the record itself if it has none; the others every independent one, else
  the first, and nothing of a record without claims;
* valid input (J13), and the claim's default id (J12);
* product objects: general grounds them (X24); term filter: general falls back to the terms before it (X28-X30), the others
  read one list strictly;
* keywords: general adds that of the holder (X45) and applies guardrails (X46, D3); lines of a reply (X33) by variant;
* a claim without keywords gives a row EMPTY but in home_appliances (J15); general merges repeats before they are stored (D2).

A claim that isn't valid gives nothing; it doesn't repeat the keywords of the claim before it. Keyword ids are hashes of record,
claim and place, so that a second run gives the same ones. An unknown variant is read as general without a tag. Records with
one record_id are taken as one (the first by patent_number); claims and replies without a record are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies as read
from ..functions.keywords import VARIANTS, breaks_guardrail, display_type, holder_keyword, valid_input
from ..functions.text import guard_norm, keyword_norm, strip
from ..sources.shared import written

STAGES = ("product_objects", "extraction", "refinement", "filtering", "combination")
CONTEXT = ("technical_field", "background_tech", "invention_content")
# Fixed values that results depend on.
NO_KEYWORDS = ("NO_KEYWORDS_TO_WRITE", "没有关键词需要写入")
NO_VALID = ("NO_VALID_KEYWORDS", "模型未产出通过护栏校验的关键词")


class Keywording(NamedTuple):
    """assembled: every keyword row of a claim, EMPTY ones too; stored: what is written; runs: a row a record."""

    assembled: DataFrame
    stored: DataFrame
    runs: DataFrame


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def tasks(records: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims that are worked on: the record's fields, seq, claim_id, claim_text, and whether the input is valid.

    Which claims a record needs is found by one combined aggregate, so that no window holds the claims of a record."""
    own = F.col("claim_type") == "INDEPENDENT"
    rank = F.when(strip(F.col("claim_id")) == "1", 0).when(own, 1).otherwise(2)
    wanted = claims.groupBy("record_id").agg(F.min(F.struct(rank.alias("rank"), "seq"))["seq"].alias("primary"), F.min("seq").alias("low"), F.bool_or(F.coalesce(own, F.lit(False))).alias("any_own"))
    fields = [c for c in records.columns if c != "record_id"]
    heads = records.groupBy("record_id").agg(F.min_by(F.struct(*fields), "patent_number" if "patent_number" in fields else fields[0]).alias("h")).select("record_id", *(F.col("h")[c].alias(c) for c in fields))
    heads = heads.join(wanted, "record_id", "left")
    plain = F.coalesce(F.col("variant"), F.lit("general"))
    general = ~plain.isin("home_appliances", "fitness")
    chosen = F.when(general, F.col("seq") == F.col("primary")).otherwise(F.when(F.col("any_own"), own).otherwise(F.col("seq") == F.col("low")))
    rows = heads.join(claims.select("record_id", "seq", "claim_id", "claim_type", "claim_text"), "record_id").filter(chosen)
    bare = heads.filter(F.col("low").isNull() & general).select("*", F.lit(None).cast(dict(claims.dtypes)["seq"]).alias("seq"), F.coalesce("patent_number", F.lit("")).alias("claim_id"), F.lit("INDEPENDENT").alias("claim_type"), F.lit("").alias("claim_text"))
    rows = rows.unionByName(bare).drop("primary", "low", "any_own").withColumn("variant", plain)
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("seq"))
    default = F.when(F.col("variant") == "home_appliances", F.concat(F.lit("RECORD-"), number.cast("string"))).otherwise(_said("claim_id"))
    rows = rows.withColumn("claim_id", F.when(strip(_said("claim_id")) == "", default).otherwise(F.col("claim_id"))).withColumn("claim_text", _said("claim_text"))
    context = F.concat(*(strip(_said(c)) for c in CONTEXT))
    return rows.withColumn("valid", valid_input(F.col("variant"), F.col("claim_text"), F.col("claim_id"), context))


def _by_stage(replies: DataFrame) -> DataFrame:
    """A column a stage: the last attempt's reply."""
    last = lambda s: F.max_by("reply", F.when(F.col("stage") == s, F.col("attempt"))).alias(s)
    return replies.filter("record_id is not null").groupBy(F.col("record_id").alias("r_id"), F.col("seq").alias("r_seq")).agg(*map(last, STAGES))


def terms(tasks_: DataFrame, replies: DataFrame) -> DataFrame:
    """Tasks with objects (primary, search), core_terms and filtered (X23, X24, X26-X30) and the replies of all stages."""
    stages = _by_stage(replies)
    rows = tasks_.join(stages, F.col("valid") & (F.col("record_id") == F.col("r_id")) & F.col("seq").eqNullSafe(F.col("r_seq")), "left").drop("r_id", "r_seq")
    general = ~F.col("variant").isin("home_appliances", "fitness")
    rows = rows.withColumn("objects", read.product_objects(_said("product_objects"), F.when(general, "general").otherwise(F.col("variant"))))
    context = F.concat(*map(_said, ("claim_text", "technical_field", "invention_content")))
    held = F.when(general, read.grounded(F.col("objects.search"), F.col("objects.primary"), context)).otherwise(F.col("objects.search"))
    rows = rows.withColumn("objects", F.struct(F.col("objects.primary").alias("primary"), held.alias("search")))
    rows = rows.withColumn("core_terms", read.refined_terms(F.col("refinement"), read.listed_terms(F.col("extraction")))["terms"])
    texts = F.filter(F.transform("core_terms", lambda x: x["text"]), lambda x: x != "")
    lenient, strict = read.filtered_terms(F.col("filtering"), texts)["terms"], read.strict_terms(F.col("filtering"))
    return rows.withColumn("filtered", F.when(F.size("core_terms") == 0, F.slice(strict, 1, 0)).when(general, lenient).otherwise(strict))


def keyworded(records: DataFrame, claims: DataFrame, replies: DataFrame) -> Keywording:
    """The whole plan of a keyword run, for many records of all variants at once.

    The keywords that replies give are written to the shared folder, so that each reply is parsed once for all three tables."""
    general = ~F.col("variant").isin("home_appliances", "fitness")
    rows = terms(tasks(records, claims), replies)
    said = read.combined_keywords(_said("combination"), F.when(general, "general").otherwise(F.col("variant")))
    objects = F.col("objects")
    merged = F.concat(F.filter(F.array(objects["primary"]), lambda x: x != ""), objects["search"])
    holder = holder_keyword(F.col("patent_holder"), objects["primary"], objects["search"], merged)
    made = F.concat(F.filter(F.array(F.when(general, holder)), lambda x: x.isNotNull()), said)
    key = ("record_id", "variant", "seq", "claim_id")
    ready = written(rows.select(*key, "valid", F.when(F.col("valid") & (F.size("filtered") > 0), made).otherwise(F.slice(said, 1, 0)).alias("k")), "keywords")
    found = ready.select(*key, F.posexplode("k").alias("place", "k")).select(*key, "place", "k.*")
    # The first of each normalized text of a claim stays; the other variants keep all.
    text = strip(F.col("keyword_text"))
    held = found.filter(general & ~breaks_guardrail(F.col("keyword_text"))).withColumn("norm", guard_norm(text))
    best = held.groupBy(*key, "norm").agg(F.min_by(F.struct("place", text.alias("keyword_text"), "keyword_type", "combination_pattern", "confidence"), "place").alias("k")).select(*key, "k.*")
    kept = best.unionByName(found.filter(~general).select(*best.columns))
    shown = kept.select(*key, "place", "keyword_text", display_type(F.col("keyword_type")).alias("keyword_type"), F.col("combination_pattern").alias("source_location"), F.lit("KEYWORD_COMBINATION").alias("generation_method"), F.col("confidence").alias("confidence_score"))
    some = shown.select(F.col("record_id").alias("s_id"), F.col("seq").alias("s_seq")).distinct()
    none = ready.filter("valid and variant <> 'home_appliances'").select(*key).join(some, (F.col("record_id") == F.col("s_id")) & F.col("seq").eqNullSafe(F.col("s_seq")), "left_anti")
    empty = none.select(*key, F.lit(0).alias("place"), F.lit("").alias("keyword_text"), F.lit("EMPTY").alias("keyword_type"), F.lit("").alias("source_location"), F.lit("NONE").alias("generation_method"), F.lit(None).cast("double").alias("confidence_score"))
    digest = F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.coalesce(F.col("seq").cast("string"), F.lit("")), F.col("place").cast("string")), 256)
    assembled = shown.unionByName(empty).withColumn("keyword_id", F.concat(F.lit("KW-"), F.left(digest, F.lit(8))))
    stored = _stored(assembled)
    return Keywording(assembled, stored, _runs(ready, assembled, stored))


def _stored(assembled: DataFrame) -> DataFrame:
    """Rows with a text, stripped; in general one a normalized text of the record, the most confident, at the place of the first."""
    general = ~F.col("variant").isin("home_appliances", "fitness")
    rows = assembled.withColumn("keyword_text", strip(F.col("keyword_text"))).filter("keyword_text <> ''")
    at = F.struct("seq", "place")
    sure = F.coalesce(F.col("confidence_score"), F.lit(0.0))
    fields = [c for c in rows.columns if c not in ("record_id", "variant", "seq", "place")]
    once = rows.filter(general).withColumn("norm", keyword_norm(F.col("keyword_text"))).filter("norm <> ''").withColumns({"sure": sure, "at": at})
    # Two steps, as the most confident of equals is the earliest: the order column falls, and seq may be of any type.
    first = once.groupBy("record_id", "variant", "norm").agg(F.min("at").alias("first"), F.min_by(F.struct(*fields), F.struct((-F.col("sure")).alias("sure"), "at")).alias("k"))
    merged = first.select("record_id", "variant", F.col("first.seq").alias("seq"), F.col("first.place").alias("place"), *(F.col("k")[c].alias(c) for c in fields))
    return merged.unionByName(rows.filter(~general).select(*merged.columns))


def _runs(judged: DataFrame, assembled: DataFrame, stored: DataFrame) -> DataFrame:
    """record_id, workflow_variant, keywords_count, exception_type and exception_message of each record with a task."""
    tagged = F.create_map(*(F.lit(x) for kv in VARIANTS.items() for x in kv))
    heads = judged.groupBy("record_id", "variant").agg(F.count("*").alias("n_tasks"))
    count = lambda df, name: df.groupBy("record_id").agg(F.count("*").alias(name))
    rows = heads.join(count(assembled, "n_rows"), "record_id", "left").join(count(stored, "n"), "record_id", "left")
    general = ~F.col("variant").isin("home_appliances", "fitness")
    said = lambda i: F.when(F.col("n_rows").isNull(), NO_KEYWORDS[i]).when(general & F.col("n").isNull(), NO_VALID[i]).otherwise("")
    return rows.select("record_id", tagged[F.col("variant")].alias("workflow_variant"), F.coalesce("n", F.lit(0).cast("long")).alias("keywords_count"), said(0).alias("exception_type"), said(1).alias("exception_message"))
