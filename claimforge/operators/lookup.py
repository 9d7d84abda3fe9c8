"""Latest runs, ladders, joins for reading and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.shared import written

# Fixed values that results depend on.
MARKETS = ("1688", "淘宝", "天猫", "京东", "拼多多", "亚马逊", "Alibaba", "eBay")
USER_ORDER = ("pending", "approved", "rejected")


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row with the largest order value of each key; max_by needs no sort and combines map-side."""
    return df.groupBy(*keys).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in columns))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered. Spark prunes each task to k rows a key before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= k)


def numbered_apart(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """row_number() where one key may have more rows than a task can sort: rows are dealt by ranges of key and order, numbered
    in each range, and moved on by the rows of the ranges before it, of which a key has as many as it has partitions."""
    rows = written(df.repartitionByRange(*keys, *order).withColumn("_cf_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*(F.col(c).alias(f"_cf_{i}") for i, c in enumerate(keys)), F.col("_cf_range").alias("_cf_at")).agg(F.count("*").alias("_cf_n"))
    before = Window.partitionBy(*(f"_cf_{i}" for i in range(len(keys)))).orderBy("_cf_at").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("_cf_before", F.coalesce(F.sum("_cf_n").over(before), F.lit(0)))
    same = F.col("_cf_range") == F.col("_cf_at")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_cf_{i}"))
    here = F.row_number().over(Window.partitionBy(*keys, "_cf_range").orderBy(*order))
    return rows.withColumn("_cf_here", here).join(moved, same).select(*df.columns, (F.col("_cf_here") + F.col("_cf_before")).alias(name))


def primary_claim(claims: DataFrame, record: str = "record_id", seq: str = "seq") -> DataFrame:
    """Claim 1, else the first independent claim, else the first."""
    prio = F.when(F.col("claim_id").cast("string") == "1", 0).when(F.col("claim_type") == "INDEPENDENT", 1).otherwise(2)
    return top_k(claims.withColumn("prio", prio), [record], [F.col("prio"), F.col(seq)], 1).drop("rn", "prio")


def variant_claims(claims: DataFrame, variant: str, record: str = "record_id", seq: str = "seq") -> DataFrame:
    """Claims a keyword variant works on: general the primary one, the others every independent claim or the first."""
    if variant == "general":
        return primary_claim(claims, record, seq)
    of = Window.partitionBy(record)
    marked = claims.withColumn("any_own", F.max(F.when(F.col("claim_type") == "INDEPENDENT", 1).otherwise(0)).over(of)).withColumn("low", F.min(seq).over(of))
    return marked.filter((F.col("claim_type") == "INDEPENDENT") | ((F.col("any_own") == 0) & (F.col(seq) == F.col("low")))).drop("any_own", "low")


def with_details(runs: DataFrame, details: DataFrame, run: str) -> DataFrame:
    """Q5: runs that have details."""
    return runs.join(details.select(run).distinct(), run, "left_semi")


def run_ladder(runs: DataFrame, details: DataFrame, keys: list[str], run: str, wanted: DataFrame | None = None) -> DataFrame:
    """The run asked for, else the latest run with details, else the latest run."""
    has = details.select(run).distinct().withColumn("has", F.lit(1))
    ranked = runs.join(has, run, "left")
    ranked = ranked.join(wanted.select(run).distinct().withColumn("asked", F.lit(1)), run, "left") if wanted is not None else ranked.withColumn("asked", F.lit(None).cast("int"))
    order = [F.coalesce("asked", F.lit(0)).desc(), F.coalesce("has", F.lit(0)).desc(), F.col(run).desc()]
    return top_k(ranked, keys, order, 1).drop("rn", "has", "asked")


def with_users(df: DataFrame, users: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Q1, Q2, Q3: rows with name and email of their user; the planner broadcasts users while they are small."""
    u = users.select(F.col("id").alias("u_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    return df.join(u, F.col(key) == F.col("u_id"), how).drop("u_id")


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions that haven't expired, with their users; the clock is given."""
    return with_users(sessions.filter(F.col("expires_at") > as_of), users, "user_id")


def approvers(users: DataFrame) -> DataFrame:
    """Q4: users with the name of who approved them."""
    a = users.select(F.col("id").alias("a_id"), F.col("name").alias("approver_name"))
    return users.join(a, F.col("approved_by") == F.col("a_id"), "left").drop("a_id")


def visible(df: DataFrame, user: str, admin: bool) -> DataFrame:
    """Administrators see all, others their own rows."""
    return df if admin else df.filter(F.col("user_id") == user)


def scoped(df: DataFrame, session: str | None) -> DataFrame:
    """Q16: a filter only if a session is given."""
    return df if not session else df.filter(F.col("analysis_session_id") == session)


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of at most 200 rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def user_rank(state: Column) -> Column:
    """W6."""
    rank = F.array_position(F.array(*map(F.lit, USER_ORDER)), state)
    return F.when(rank > 0, rank).otherwise(len(USER_ORDER) + 1)


def market_order(source: str = "product_source", price: str = "price", compat: bool = False) -> list[Column]:
    """By marketplace, then by the number a price begins with; unknown markets come last (first with compat)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, MARKETS)), F.col(source)), F.lit(0))
    number = F.regexp_extract(F.coalesce(price, F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return [rank if compat else F.when(rank == 0, 99).otherwise(rank), F.asc_nulls_last(number)]


def by_local_name(column: str = "product_name") -> Column:
    """Chinese collation."""
    return F.collate(F.col(column), "zh")


def enriched(comparisons: DataFrame, products: DataFrame, fields: list[str], key: str = "product_key") -> DataFrame:
    """Q11, Q12: full outer merge: empty fields filled from products, unknown products added."""
    p = products.select(F.col(key).alias("p_key"), *(F.col(f).alias(f"p_{f}") for f in fields))
    joined = comparisons.join(p, F.col(key) == F.col("p_key"), "full")
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("").cast(dict(comparisons.dtypes)[f])) if dict(comparisons.dtypes)[f] == "string" else F.col(f), F.col(f"p_{f}")) for f in fields}
    return joined.withColumns({key: F.coalesce(key, "p_key"), **filled}).drop("p_key", *(f"p_{f}" for f in fields))


def by_id_or_name(products: DataFrame, comparisons: DataFrame, value: str) -> DataFrame:
    """Q13: a comparison value by product id, else by name; comparisons have one row an id and one a name."""
    by_id = comparisons.select(F.col("product_id").alias("i_id"), F.col(value).alias("by_id"))
    by_name = comparisons.groupBy(F.col("product_name").alias("n_name")).agg(F.min_by(value, "product_id").alias("by_name"))
    joined = products.join(by_id, F.col("product_id") == F.col("i_id"), "left").join(by_name, F.col("product_name") == F.col("n_name"), "left")
    return joined.withColumn(value, F.coalesce("by_id", "by_name")).drop("i_id", "n_name", "by_id", "by_name")


def local_images(df: DataFrame, paths: DataFrame, key: str, images: str = "evidence_images") -> DataFrame:
    """Image urls replaced by local paths, in order; urls without a path are dropped, rows without any hit stay."""
    p = paths.select(F.col("url").alias("p_url"), "path")
    hits = df.select(key, F.posexplode(images).alias("at", "u")).join(p, F.col("u") == F.col("p_url")).groupBy(F.col(key).alias("h_key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("found"))
    return df.join(hits, F.col(key) == F.col("h_key"), "left").withColumn(images, F.coalesce("found", images)).drop("h_key", "found")


def nested_records(records: DataFrame, claims: DataFrame, figures: DataFrame, key: str = "record_id") -> DataFrame:
    """Q7: records with arrays of their claims and figures."""
    pack = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", *(c for c in df.columns if c not in (key, "id"))))).alias(name))
    return records.join(pack(claims, "claims"), key, "left").join(pack(figures, "figures"), key, "left")


def inferred_patent(*runs: DataFrame, session: str = "analysis_session_id") -> DataFrame:
    """The first positive patent id of the newest keyword, search and compare run."""
    tagged = None
    for rank, df in enumerate(runs):
        part = df.groupBy(session).agg(F.max_by("patent_record_id", "id").alias("patent")).withColumn("rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.filter("patent > 0").groupBy(session).agg(F.min_by("patent", "rank").alias("patent_record_id"))


def child_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table; one aggregate a table, no data moved but the counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def without_same_name(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows and those extra rows whose key base doesn't have."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Sequence number and letter."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("seq_no", n).withColumn("letter", F.when(F.col("seq_no") <= 26, F.chr(F.col("seq_no") + 64)))


def price_number(price: Column) -> Column:
    """Leading number of a price text."""
    return F.regexp_extract(strip(price), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")
