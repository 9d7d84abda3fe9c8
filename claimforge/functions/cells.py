"""Cells of spreadsheet records: text, link, number and list readers and their mapping to patents,
products and comparisons (J22, J23). A record is a variant; its tables come in as rows (S14, S15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import status
from .text import split_clean

# The columns that a field is read from, in order.
PATENT = {"title": ("专利标题", "标题", "title"), "patent_number": ("专利号", "申请号", "patent_number"), "specification": ("说明书", "摘要", "specification")}
PATENT_LISTS = {"independent_claims": ("独立权利要求", "independent_claims"), "dependent_claims": ("从属权利要求", "dependent_claims"), "drawings": ("附图", "drawings")}
PRODUCT = {"product_id": ("商品ID", "id"), "product_name": ("商品名称", "产品名称", "name"), "description": ("商品描述", "描述", "description"), "product_source": ("来源", "平台", "source"), "price": ("价格", "price")}
PRODUCT_LINKS = {"product_url": ("商品链接", "链接", "url"), "image_url": ("图片", "image_url")}
COMPARISON = {
    "claim_element": ("权利要求特征", "专利技术特征", "claim_element"),
    "product_feature": ("商品特征", "产品技术特征", "product_feature"),
    "result": ("匹配状态", "比对结果", "status"),
    "reasoning": ("推理过程", "比对分析", "reasoning"),
    "patent_reference": ("专利原文", "patent_reference"),
    "product_reference": ("商品原文", "product_reference"),
}


def _path(name: str) -> str:
    return f"$['{name}']"


def _kind(record: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, _path(name), "variant"))


def _plain(record: Column, name: str) -> Column:
    """A string cell, or a number or true as text; zero, false and null are nothing."""
    value = F.try_variant_get(record, _path(name), "string")
    return F.when(_kind(record, name) == "STRING", value).when(_kind(record, name).rlike("^(ARRAY|OBJECT)"), None).otherwise(F.when(~value.isin("0", "false"), value))


def _items(record: Column, name: str) -> Column:
    return F.try_variant_get(record, _path(name), "array<variant>")


def _string(item: Column) -> Column:
    return F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))


def text_cell(record: Column, name: str) -> Column:
    """A text, the joined texts of a list of parts, or the text of an object; else empty."""
    parts = F.array_join(F.transform(_items(record, name), lambda x: F.coalesce(_string(x), F.try_variant_get(x, "$.text", "string"), F.lit(""))), "")
    return F.coalesce(parts, F.try_variant_get(record, f"{_path(name)}.text", "string"), _plain(record, name), F.lit(""))


def link_cell(record: Column, name: str) -> Column:
    """A text as it is, the first link or http text of a list, or the link of an object; else a text
    that begins with http; else empty."""
    listed = F.transform(_items(record, name), lambda x: F.coalesce(F.try_variant_get(x, "$.link", "string"), F.when(F.startswith(_string(x), F.lit("http")), _string(x))))
    first = F.get(F.filter(listed, lambda x: x.isNotNull()), F.lit(0))
    text = text_cell(record, name)
    return F.coalesce(F.when(_kind(record, name) == "STRING", text), first, F.try_variant_get(record, f"{_path(name)}.link", "string"), F.when(F.startswith(text, F.lit("http")), text), F.lit(""))


def number_cell(record: Column, name: str) -> Column:
    """A number, or the number that a text begins with; else null."""
    text = F.regexp_extract(F.when(_kind(record, name) == "STRING", F.try_variant_get(record, _path(name), "string")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.coalesce(text, F.when(_kind(record, name).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(record, _path(name), "double")))


def list_cell(record: Column, name: str) -> Column:
    """The non-empty texts of a list, or the stripped non-blank lines of a text; null if there is neither."""
    listed = F.transform(_items(record, name), lambda x: F.coalesce(_string(x), F.try_variant_get(x, "$.text", "string"), F.to_json(x)))
    text = text_cell(record, name)
    return F.coalesce(F.filter(listed, lambda x: x != ""), F.when(text != "", split_clean(text, "\n")))


def _first(read, record: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(read(record, n), F.lit("")) for n in names), F.lit(""))


def patent_record(record: Column) -> Column:
    """Struct of a patent; it is read from the first record of its table."""
    lists = {k: F.coalesce(*(list_cell(record, n) for n in names)) for k, names in PATENT_LISTS.items()}
    return F.struct(*(_first(text_cell, record, names).alias(k) for k, names in PATENT.items()), *(v.alias(k) for k, v in lists.items()))


def product_record(record: Column, place: Column) -> Column:
    """Struct of a product; place is the record's number from 1 on."""
    fields = {k: _first(text_cell, record, names) for k, names in PRODUCT.items()} | {k: _first(link_cell, record, names) for k, names in PRODUCT_LINKS.items()}
    # A price of zero is a price: the number is read where no text is.
    number = number_cell(record, "价格")
    fields["price"] = F.coalesce(F.nullif(fields["price"], F.lit("")), F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string")), F.lit(""))
    fields["product_id"] = F.coalesce(F.nullif(fields["product_id"], F.lit("")), F.concat(F.lit("product_"), place.cast("string")))
    fields["product_name"] = F.coalesce(F.nullif(fields["product_name"], F.lit("")), F.concat(F.lit("商品 "), place.cast("string")))
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def comparison_rows(records: DataFrame, record: str = "record") -> DataFrame:
    """Flat comparison rows of records, with their status by the reading of such tables (A5)."""
    r = F.col(record)
    id_ = F.coalesce(*(F.nullif(text_cell(r, n), F.lit("")) for n in ("商品ID", "product_id")), F.lit("unknown"))
    name = F.coalesce(*(F.nullif(text_cell(r, n), F.lit("")) for n in ("商品名称", "product_name")), id_)
    read = records.select(*(c for c in records.columns if c != record), id_.alias("product_id"), name.alias("product_name"), *(_first(text_cell, r, names).alias(k) for k, names in COMPARISON.items()))
    return read.withColumn("status", status(F.col("result"), "bitable"))


def table_records(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows (table_name, seq, record_json) of scanned tables as variants; a table that wasn't read has
    no rows, a record that doesn't parse is null and dropped."""
    return rows.filter(F.col("table_name").isin(names)).select("table_name", "seq", F.try_parse_json("record_json").alias("record")).filter("record is not null")
