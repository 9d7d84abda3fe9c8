"""Projections and joins between the modules' inputs and outputs (J4, J7, J15-J19, X5, X39, A15, A19, A21,
W9, W14, W16, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patent import section_of
from ..functions.text import strip

# Fixed values that results depend on.
FIELD = ("技术领域", "technical field")
BACKGROUND = ("背景技术", "background")
INVENTION = ("发明内容", "实用新型内容", "发明概述", "summary")
LIMITS = {"summary": 6000, "structure": 5000, "industry": 4000}


def _full(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def loaded(patents: DataFrame, sections: str = "sections") -> DataFrame:
    """The fields that keyword extraction reads of a patent: the application date else the priority date; the
    invention section else all sections, one a line."""
    s = F.col(sections)
    every = F.array_join(F.transform(s, lambda x: x["section_text"]), "\n")
    fields = {
        "patent_holder": F.coalesce("patent_holder", F.lit("")),
        "patent_number": F.coalesce("patent_number", F.lit("")),
        "application_date": F.coalesce(_full("application_date"), _full("priority_date"), F.lit("")),
        "technical_field": section_of(s, *FIELD),
        "background_tech": section_of(s, *BACKGROUND),
        "invention_content": F.coalesce(_full(section_of(s, *INVENTION)), every),
    }
    return patents.withColumns(fields)


def filled(*tiers: Column, fields: tuple[str, ...] = ("patent_number", "application_date", "priority_date", "patent_holder", "title")) -> Column:
    """Struct of metadata, each field from the first tier (reply, bracket codes, fallback) that has it."""
    return F.struct(*(F.coalesce(*(_full(t[f]) for t in tiers)).alias(f) for f in fields))


def offsets(raw: Column, text: Column) -> Column:
    """Struct of start and end of a section in the raw text: the first occurrence, -1 if there is none; an
    empty section has 0 and 0."""
    start = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.position(text, raw) - 1)
    return F.struct(start.alias("start_position"), (start + F.length(F.coalesce(text, F.lit("")))).alias("end_position"))


def excerpt(text: Column, use: str = "summary", notice: str = "") -> Column:
    """The first characters of a text for a use; a cut one ends with the notice."""
    n = LIMITS[use]
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(notice))).otherwise(text)


def keyword_rows(runs: DataFrame, keywords: DataFrame, variant: str, run: str = "run_id") -> DataFrame:
    """The keywords of each run; a run without any has one row EMPTY with an empty text, but none in the
    home-appliance variant."""
    if variant == "home_appliances":
        return runs.select(run).join(keywords, run)
    out = runs.select(run).join(keywords, run, "left")
    return out.withColumns({"keyword_id": F.coalesce("keyword_id", F.lit("EMPTY")), "keyword_text": F.coalesce("keyword_text", F.lit(""))})


def compare_input(products: DataFrame) -> DataFrame:
    """Product rows as input of a comparison: the product's id else the row's, nulls as empty values."""
    return products.select(
        F.coalesce(_full("product_id"), F.col("id").cast("string")).alias("id"),
        F.coalesce("product_name", F.lit("")).alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("picture", F.array().cast("array<string>")).alias("images"),
        F.coalesce("raw_payload", F.lit("{}")).alias("raw_data"),
    )


def all_errors(read: Column, *lists: Column) -> Column:
    """The read error, if any, then the errors of identification, claims and figures, in that order."""
    return F.concat(F.filter(F.array(read), lambda e: e.isNotNull()), *(F.coalesce(x, F.filter(F.array(read), lambda e: F.lit(False))) for x in lists))


def split_errors(errors: Column) -> Column:
    """Struct of critical and recoverable errors, and whether there is a critical one (then the run stops)."""
    critical = F.filter(errors, lambda e: ~e["is_recoverable"])
    return F.struct((F.size(critical) > 0).alias("stop"), critical.alias("critical"), F.filter(errors, lambda e: e["is_recoverable"]).alias("recoverable"))


def claim_lists(claims: DataFrame, record: str = "record_id", seq: str = "seq") -> DataFrame:
    """Texts of independent and of dependent claims in order, blank ones dropped."""
    own = F.col("claim_type") == "INDEPENDENT"
    listed = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(seq, "claim_text")))), lambda x: x["claim_text"])
    return claims.filter(strip("claim_text") != "").groupBy(record).agg(listed(own).alias("independent_claims"), listed(~own).alias("dependent_claims"))


def latest_run(runs: DataFrame, run: str = "id") -> DataFrame:
    """A15."""
    return runs.agg(F.max(run).alias(run))


def claim_count(features: DataFrame, run: str) -> DataFrame:
    """Distinct claim ids (null counts as empty) of each run's features."""
    return features.groupBy(run).agg(F.count_distinct(F.coalesce(F.col("claim_id").cast("string"), F.lit(""))).alias("n_claims"))


def user_split(users: DataFrame, state: str = "status") -> DataFrame:
    """How many users wait and how many don't."""
    return users.agg(F.count_if(F.col(state) == "pending").alias("n_pending"), F.count_if(~F.col(state).eqNullSafe(F.lit("pending"))).alias("n_other"))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """W9 (product_id, id), W14 (the input's seq): the order of an output; nothing before it is sorted."""
    return rows.orderBy(*columns)


def scoped_products(scopes: DataFrame, products: DataFrame, key: str = "session_id") -> DataFrame:
    """Products of each scope (session_id, run_ids, patent_id): of its runs if it names any, else of its patent."""
    by_run = scopes.filter(F.size("run_ids") > 0).select(key, F.explode(F.array_distinct("run_ids")).alias("search_run_id"))
    by_patent = scopes.filter(F.coalesce(F.size("run_ids"), F.lit(0)) <= 0).select(key, F.col("patent_id").alias("patent_record_id"))
    return by_run.join(products, "search_run_id").select(key, *products.columns).unionByName(by_patent.join(products, "patent_record_id").select(key, *products.columns))


def appended(*lists: DataFrame) -> DataFrame:
    """The keywords of all records, duplicates kept."""
    out = lists[0]
    for df in lists[1:]:
        out = out.unionByName(df)
    return out
