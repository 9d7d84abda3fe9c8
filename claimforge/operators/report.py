"""Report tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import label
from ..functions.text import first_image, html_escape, shortened
from .lookup import numbered_apart
from .verdict import by_claim, flat


def overview(products: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row a product, with the claim-level verdict and counts; products without results are uncertain. seq is the products' own."""
    counts = flat(comparisons).drop("verdict", "n_total")
    joined = products.join(counts, "product_id", "left").join(by_claim(comparisons).drop("n_claims"), "product_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    verdict = F.coalesce("verdict", F.lit("uncertain"))
    sheets = sheet_names(products, "product_id", "product_name").withColumnRenamed("product_id", "s_id")
    rows = joined.join(sheets, F.col("product_id") == F.col("s_id"))
    own = ["seq"] if "seq" in products.columns else []
    return rows.select(*own, "product_id", "product_name", "product_source", "price", "brand", first_image(F.col("picture")).alias("first_picture"), "product_url", verdict.alias("verdict"), label(verdict).alias("verdict_label"), *(zero(c) for c in ("n_matching", "n_not_matching", "n_uncertain")), "sheet_name")


# Fixed values of the report.
STATUS_LABELS = {"matching": "相同/等同", "not_matching": "不相同"}
UNSURE, NOTHING, BLANK = "不确定", "未找到该商品的数据库比对结果", "—"


def detail(products: DataFrame, comparisons: DataFrame) -> DataFrame:
    """R2: one row a feature, a placeholder for products without results; reasoning is reason and type, blanks skipped; status labels and
    images, one a line, as the report shows them. comparisons may lack evidence_images."""
    parts = F.filter(F.array("reason", "reasoning_type"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    images = F.array_join("evidence_images", "\n") if "evidence_images" in comparisons.columns else F.lit("")
    rows = products.select("product_id", "product_name").join(comparisons.select("product_id", "seq", "feature_id", "claim_id", "feature_text", "evidence", "status", F.array_join(parts, " | ").alias("reasoning"), images.alias("images")), "product_id", "left")
    none = F.col("seq").isNull()
    status = F.coalesce(*(F.when(F.col("status") == k, v) for k, v in STATUS_LABELS.items()), F.lit(UNSURE))
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(BLANK))
    return rows.withColumns({"placeholder": none, "status_label": F.when(none, BLANK).otherwise(status), "feature_text": F.when(none, NOTHING).otherwise(shown("feature_text")), "images": shown("images"), "claim_id": shown("claim_id"), "evidence": shown("evidence")})


def sheet_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Sheet names of 31 characters; names that clash without case get _2, _3 ... in key order."""
    bare = F.left(F.regexp_replace(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("product")), r"[\[\]:*?/\\]", " "), F.lit(31))
    named = df.select(key, bare.alias("_bare"), F.lower(bare).alias("_lower"))
    bare, n = F.col("_bare"), F.col("_no")
    suffix = F.concat(F.lit("_"), n.cast("string"))
    return numbered_apart(named, ["_lower"], [key], "_no").select(key, F.when(n == 1, bare).otherwise(F.concat(F.left(bare, F.lit(31) - F.length(suffix)), suffix)).alias("sheet_name"))


def chart_pages(products: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One HTML page a product, assembled in order; write it partitioned by product_id."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("feature_id"), cell("feature_text"), cell("evidence"), cell("status"), cell("reasoning"), F.lit("</tr>"))
    body = detail(products, comparisons).groupBy("product_id", "product_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "feature_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    title = html_escape(shortened(F.coalesce("product_name", F.lit("")), 20))
    return body.select("product_id", F.concat(F.lit("<!DOCTYPE html><title>"), title, F.lit("</title><table>"), "rows", F.lit("</table>")).alias("value"))
