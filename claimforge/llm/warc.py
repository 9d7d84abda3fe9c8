"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

write() makes one record a page; of pages with equal payloads of ``LEAST_BYTES`` or more the smallest
page_id is a response and the others revisit it. Files are plain WARC/1.1 text, written by Spark.

read() splits files at the magic line wherever it occurs, also inside payloads. Each piece is a
candidate record: its header gives the offset at which its successor must begin. Offsets come from
running sums of piece lengths (inside each input split, then over the splits of a file). From offset 0
of every file, pointer jumping (reach one hop, then double every hop) keeps the reachable candidates
only; magic inside a payload is never reached. Pieces of a payload that holds magic are put together
again, and every payload's SHA-256 must equal the digest in its header.

Edge cases: null html is empty; null url has no target header, line breaks in a url are percent-encoded;
pages with one page_id and equal payloads are responses all; a null page_id is kept and never
revisits; a file that doesn't begin with a record has no records; an empty table gives no rows.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """One WARC record a page, without the end mark, in the column record."""
    body = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", "url", body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("n"))
    large = named.filter(F.col("n") >= LEAST_BYTES).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again = large.join(firsts, "digest").filter("page_id > first").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    again = written(again, "revisits")
    joined = named.join(again, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("first").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        F.concat(
            F.lit(MAGIC),
            header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            header("WARC-Record-ID", urn("page_id")),
            header("WARC-Date", F.lit(DATE)),
            header("WARC-Target-URI", uri),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            header("WARC-Refers-To", F.when(revisit, urn("first"))),
            header("Content-Type", F.lit("application/http; msgtype=response")),
            header("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("record")
    )


def write(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: file, split, order in the split, bytes."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields of every piece and the digest of a payload that lies in it whole."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1), F.lit(""))
    cut_head = pieces.select("file", "split", "seq", F.octet_length("value").cast("long").alias("size"), head.alias("head"), "value")
    fields = cut_head.select("file", "split", "seq", "size", "value", (F.octet_length("head") + len(END)).cast("long").alias("h"), *(field(n).alias(a) for n, a in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers"), ("WARC-Payload-Digest", "said"))), field("Content-Length").try_cast("long").alias("content"))
    whole = F.col("content") + len(END) <= F.col("size") - F.col("h")
    block = F.when(whole, F.substring(F.col("value").cast("binary"), F.col("h").cast("int") + 1, F.col("content").cast("int")))
    return _digested(fields.withColumn("block", block).drop("value"))


def _digested(df: DataFrame) -> DataFrame:
    """Replaces block (an HTTP message, or null) by payload_bytes and payload_digest."""
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    return df.withColumn("http", http).withColumn("payload_bytes", (F.octet_length("block") - F.col("http")).cast("long")).withColumn("payload_digest", F.sha2(F.substring(F.col("block"), F.col("http") + 1, F.greatest(F.octet_length("block") - F.col("http"), F.lit(0))), 256)).drop("block", "http")


def reachable(candidates: DataFrame) -> DataFrame:
    """file and off of the candidates (file, off, nxt) on the chain from offset 0 of each file."""
    hop = cut(candidates.select("file", "off", "nxt"))
    found = cut(hop.filter("off = 0").select("file", "off").distinct())
    while not hop.isEmpty():
        ends = hop.select(F.col("file").alias("h_file"), F.col("off").alias("h_off"), F.col("nxt").alias("h_nxt"))
        # One hop from all that is reached; hops then double, so what is reached doubles too.
        step = found.join(ends, (F.col("file") == F.col("h_file")) & (F.col("off") == F.col("h_off"))).select("file", F.col("h_nxt").alias("off"))
        found = cut(found.union(step).distinct())
        hop = cut(hop.join(ends, (F.col("file") == F.col("h_file")) & (F.col("nxt") == F.col("h_off"))).select("file", "off", F.col("h_nxt").alias("nxt")))
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, off, record_type, page_id, refers_to, payload_bytes, payload_digest of every record."""
    slim = cut(_parsed(_pieces(spark, path)))
    splits = slim.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = splits.select(F.col("file").alias("b_file"), F.col("split").alias("b_split"), before.alias("base"))
    in_split = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = F.col("base") + F.col("inner") - len(MAGIC)  # of the magic before the piece
    placed = slim.withColumn("inner", in_split).join(base, (F.col("file") == F.col("b_file")) & (F.col("split") == F.col("b_split"))).withColumn("off", off).drop("b_file", "b_split", "base", "inner")
    nxt = F.col("off") + len(MAGIC) + F.col("h") + F.col("content") + len(END)
    placed = cut(placed.withColumn("nxt", nxt))
    chain = reachable(placed.filter("off >= 0 and nxt is not null and record_type is not null"))
    c = chain.select(F.col("file").alias("c_file"), F.col("off").alias("c_off"))
    kept = placed.join(c, (F.col("file") == F.col("c_file")) & (F.col("off") == F.col("c_off"))).drop("c_file", "c_off")
    broken = kept.filter("payload_digest is null").select("file", "off", "h", "content")
    joined = kept.join(_assembled(spark, path, placed, broken), ["file", "off"], "left")
    digest = F.coalesce("payload_digest", "a_digest")
    same = F.col("record_type").eqNullSafe("revisit") | (F.concat(F.lit("sha256:"), digest) == F.coalesce("said", F.concat(F.lit("sha256:"), digest)))
    number = lambda c: F.regexp_extract(c, "(-?\\d+)>$", 1).try_cast("long")
    return joined.select(
        "file",
        "off",
        "record_type",
        number("record_id").alias("page_id"),
        number("refers").alias("refers_to"),
        F.coalesce("payload_bytes", "a_bytes").alias("payload_bytes"),
        F.when(same, F.when(F.col("record_type") == "revisit", F.substring_index("said", ":", -1)).otherwise(digest)).otherwise(F.raise_error(F.lit("a payload doesn't match its digest"))).alias("payload_digest"),
    )


def _assembled(spark: SparkSession, path: str, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Payloads that hold magic: the pieces from the record to its end, joined by the magic again."""
    b = broken.select(F.col("file").alias("k_file"), F.col("off").alias("k_off"), F.col("h").alias("k_h"), F.col("content").alias("k_content"))
    marked = placed.join(b, (F.col("file") == F.col("k_file")) & (F.col("off") == F.col("k_off")), "left")
    last = lambda c: F.last(c, ignorenulls=True).over(Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owned = marked.withColumns({"r_off": last("k_off"), "r_h": last("k_h"), "r_content": last("k_content")}).filter(F.col("off") < F.col("r_off") + len(MAGIC) + F.col("r_h") + F.col("r_content"))
    parts = written(owned.select(F.col("file").alias("w_file"), F.col("split").alias("w_split"), F.col("seq").alias("w_seq"), "off", "r_off", "r_h", "r_content"), "parts")
    # The same plan over the same files deals pieces out alike; the digests show it if it ever didn't.
    values = _pieces(spark, path).join(parts, (F.col("file") == F.col("w_file")) & (F.col("split") == F.col("w_split")) & (F.col("seq") == F.col("w_seq")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC)
    whole = values.groupBy("file", "r_off", "r_h", "r_content").agg(text.alias("text"))
    block = F.substring(F.col("text").cast("binary"), F.col("r_h").cast("int") + 1, F.col("r_content").cast("int"))
    return _digested(whole.withColumn("block", block)).select("file", F.col("r_off").alias("off"), F.col("payload_bytes").alias("a_bytes"), F.col("payload_digest").alias("a_digest"))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to path (new in the shared folder by default), reads them back, and returns
    page_id, payload_bytes, payload_digest, record_type, refers_to, all from the archives."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write(pages, path)
    found = cut(read(spark, path))
    targets = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("t_id"), F.col("payload_digest").alias("t_digest")).agg(F.min("payload_bytes").alias("t_bytes"))
    revisits = found.filter("record_type = 'revisit'").join(targets, (F.col("refers_to") == F.col("t_id")) & (F.col("payload_digest") == F.col("t_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").select(columns).unionByName(revisits.withColumn("payload_bytes", F.col("t_bytes")).select(columns))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN first END AS refers_to FROM p
"""
