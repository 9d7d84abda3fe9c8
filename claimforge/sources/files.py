"""Sources: files, tables and external replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import file_kind
from ..functions.text import no_ws, safe_file_name, strip
from . import schemas

REMOTE_LIMIT = 100 << 20
UPLOAD_LIMIT = 50 << 20
OCR_GLUE = "\n\n"
UPLOAD_TYPES = {"pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}


def file_format(url: Column, declared: Column) -> Column:
    """Format by the path's extension, else by a query parameter's, else by the declared type."""
    ext = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    path = F.regexp_replace(url, r"[?#].*$", "")
    named = [ext(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1)) for p in ("file_path", "file", "name", "filename")]
    return F.coalesce(ext(path), *named, F.when(declared == "document", "pdf").otherwise("txt"))


def binary_files(spark: SparkSession, path: str, glob: str = "*", limit: int | None = REMOTE_LIMIT) -> DataFrame:
    """Files with their bytes; the size limit is a filter that Spark pushes to the listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files if limit is None else files.filter(F.col("length") <= limit)


def raw_text(files: DataFrame) -> DataFrame:
    """UTF-8 text of files as it is (no tags stripped); errors in a column, not in the text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", file_kind(F.col("path")).alias("kind"), text.alias("raw_text"), F.when(text.isNull(), "NOT_UTF8").alias("read_error"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text"))


def first_usable(*candidates: Column, least: int = 50) -> Column:
    """The first text of at least 50 stripped characters that isn't a reader's error."""
    good = lambda c: F.when((F.length(strip(c)) >= least) & ~F.startswith(strip(c), F.lit("[")), c)
    return F.coalesce(*map(good, candidates))


def text_gate(text: Column, least: int = 100) -> Column:
    """Error code of a text that is too short, else null."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) < least, "EMPTY_OR_CORRUPT_FILE")


def page_text(pages: DataFrame, key: str = "path", glue: str = "\n") -> DataFrame:
    """Texts of pages that an external reader made (key, page, text), joined in order; empty pages dropped. Pages of character
    recognition (S3) are joined by a blank line (OCR_GLUE)."""
    full = pages.filter(no_ws("text") != "")
    return full.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), glue).alias("raw_text"))


def table(spark: SparkSession, name: str) -> DataFrame:
    """A stored table, or an empty one of its schema if it isn't there."""
    return schemas.conform(spark.table(name), name) if spark.catalog.tableExists(name) else schemas.empty(spark, name)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str = "id", parts: int = 16, low: int = 0, high: int = 1 << 40) -> DataFrame:
    """A database table in parts by key; filters on it are pushed down."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Sessions stored as JSON files; files that aren't JSON give no rows."""
    kind = "id string, user_id long, status string, title string, results map<string,string>, created_at timestamp"
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


# What the name or a column of a table of products or comparisons contains.
PRODUCT_NAMES = ("商品", "product", "产品", "检索")
COMPARISON_NAMES = ("比对", "comparison", "侵权", "特征")
PRODUCT_COLUMNS = ("商品", "产品", "product")
COMPARISON_COLUMNS = ("权利要求", "特征", "claim", "比对")
SHARED_COLUMNS = ("权利要求", "技术特征", "claim", "匹配", "比对", "侵权")


def table_kind(name: str, columns: list[str]) -> str | None:
    """Products or comparisons by what the table's name contains (case aside), else by what its columns' names contain (in
    their case); a table with columns of both is one of comparisons."""
    has = lambda texts, parts: any(p in x for x in texts for p in parts)
    if has([name.lower()], PRODUCT_NAMES):
        return "products"
    if has([name.lower()], COMPARISON_NAMES) or has(columns, COMPARISON_COLUMNS):
        return "comparisons"
    return "products" if has(columns, PRODUCT_COLUMNS) else None


def sniffed(tables: dict[str, list[str]]) -> dict[str, str]:
    """The table of each kind by the columns of tables that have records, in order. Of several of a kind the last counts; without one of
    comparisons, but with products, the first table with a column of either counts for both."""
    found = {kind: name for name, columns in tables.items() if (kind := table_kind(name, columns))}
    if "products" in found and "comparisons" not in found:
        both = next((n for n, columns in tables.items() if any(p in c for c in columns for p in SHARED_COLUMNS)), None)
        found |= {"comparisons": both} if both else {}
    return found


def kinds(records: DataFrame) -> DataFrame:
    """S17 as a table: (table_name, kind) of scanned tables (table_name, record as a variant), by the columns of each one's first record (seq)."""
    first = records.groupBy("table_name").agg(F.min_by(F.map_keys(F.try_variant_get("record", "$", "map<string,variant>")), "seq").alias("columns"))
    name = F.lower("table_name")
    part = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    column = lambda words: F.exists("columns", lambda c: part(c, words))
    kind = F.when(part(name, PRODUCT_NAMES), "products").when(part(name, COMPARISON_NAMES) | column(COMPARISON_COLUMNS), "comparisons").when(column(PRODUCT_COLUMNS), "products")
    return first.select("table_name", kind.alias("kind"))


def find_table(names: list[str], part: str) -> str | None:
    """The first name that contains part without case, else the first name."""
    return next((n for n in names if part.lower() in n.lower()), names[0] if names else None)


def uploads(files: DataFrame) -> DataFrame:
    """Accepted uploads (by type or extension, up to 50 MB) with safe names; files has name, mime, length."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    fits = F.col("mime").isin(*UPLOAD_TYPES.values()) | ext.isin(*UPLOAD_TYPES)
    return files.filter(F.coalesce(fits, F.lit(False)) & (F.col("length") <= UPLOAD_LIMIT)).withColumn("safe_name", safe_file_name(F.col("name")))
