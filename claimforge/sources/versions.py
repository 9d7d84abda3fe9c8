"""Parents and their children replaced in one step on plain Parquet (K1, K4, K5, K6).

A store is a folder with tables in buckets by their key. A change writes the touched buckets anew beside the old ones and then one
commit file, which names the folder of every bucket of every table. Until that file has its name, readers see the old
state; a crash before leaves folders that nothing names (unused() removes them). Of two writers that start from
the same state the second fails and can try again. A change that carries a batch of a writer is applied once.

The driver handles bucket numbers only, at most BUCKETS a table. A key with many rows is written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import upserted

BUCKETS = 64
BUCKET = "_cf_bucket"


@dataclass
class Change:
    """keys: a table with the keys whose rows go; rows: what stands in their place, nothing for a key that loses all its rows."""

    rows: DataFrame
    keys: DataFrame
    key: str


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(root: str) -> str:
    return f"{root}/_commits"


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def state(spark: SparkSession, root: str) -> dict:
    """The last commit: version, schemas and folders by table, and the last batch of each writer."""
    found = [n for n in _names(spark, _commits(root)) if n.endswith(".json")]
    if not found:
        return {"version": 0, "schemas": {}, "folders": {}, "done": {}}
    return json.loads(spark.read.option("wholetext", "true").text(f"{_commits(root)}/{found[-1]}").first().value)


def _committed(spark: SparkSession, root: str, new: dict) -> None:
    """Written under another name, then renamed, which fails if the version exists."""
    jvm = spark.sparkContext._jvm
    begun, fs = _hadoop(spark, f"{_commits(root)}/.{uuid.uuid4().hex}")
    fs.mkdirs(begun.getParent())
    out = fs.create(begun, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(begun.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    files.rename(begun, jvm.org.apache.hadoop.fs.Path(f"{_commits(root)}/{new['version']:012d}.json"), options)


def _read(spark: SparkSession, root: str, now: dict, name: str, buckets: list[int] | None = None) -> DataFrame | None:
    if name not in now["schemas"]:
        return None
    folders = [f for b, f in now["folders"][name].items() if buckets is None or int(b) in buckets]
    schema = now["schemas"][name]
    return spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A table as of the last commit; an empty one of the schema if it isn't there."""
    found = _read(spark, root, state(spark, root), name)
    return spark.createDataFrame([], schema) if found is None else found


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def commit(spark: SparkSession, root: str, changes: dict[str, Change], writer: str | None = None, batch: int = 0, before_commit: Callable[[], None] = lambda: None) -> int:
    """Applies all changes or none; the version that then holds. before_commit runs between the writes and the commit."""
    now = state(spark, root)
    if writer is not None and now["done"].get(writer, -1) >= batch:
        return now["version"]
    new = json.loads(json.dumps(now)) | {"version": now["version"] + 1}
    for name, change in changes.items():
        keys = change.keys.select(change.key).distinct()
        touched = [r[0] for r in keys.select(_bucket(change.key)).distinct().collect()]  # at most BUCKETS numbers
        old, rows = _read(spark, root, now, name, touched), change.rows
        if old is not None:
            gone = keys.withColumnRenamed(change.key, "_cf_key")
            rows = old.join(gone, old[change.key].eqNullSafe(gone["_cf_key"]), "left_anti").unionByName(rows, allowMissingColumns=True).select(*old.columns)
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, _bucket(change.key)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
        kept = {b: f for b, f in now["folders"].get(name, {}).items() if int(b) not in touched}
        made = {n.partition("=")[2]: f"{folder}/{n}" for n in _names(spark, f"{root}/{folder}") if n.startswith(BUCKET)}
        new["folders"][name], new["schemas"][name] = kept | made, now["schemas"].get(name) or ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    if writer is not None:
        new["done"][writer] = batch
    before_commit()
    _committed(spark, root, new)
    return new["version"]


def unused(spark: SparkSession, root: str) -> list[str]:
    """Removes folders that the last commit doesn't name, and earlier commits; not while another writer or an old reader is at work."""
    now = state(spark, root)
    named = {f.split("/")[0] for folders in now["folders"].values() for f in folders.values()}
    old = [n for n in _names(spark, root) if n not in named and n != "_commits"] + [f"_commits/{n}" for n in _names(spark, _commits(root)) if n != f"{now['version']:012d}.json"]
    for n in old:
        where, fs = _hadoop(spark, f"{root}/{n}")
        fs.delete(where, True)
    return old


def resolved_runs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K4: new runs with the id of the stored run they mean, found by claim_compare_run_id, else by run_id, else a new id from
    the run_id's digest; and how it was found."""
    by_id = stored.select(F.col("id").alias("_cf_id")).distinct()
    by_run = stored.filter("run_id <> ''").groupBy(F.col("run_id").alias("_cf_run")).agg(F.min("id").alias("_cf_run_id"))
    found = new.join(by_id, F.col("_cf_id") == F.when(F.col("claim_compare_run_id") > 0, F.col("claim_compare_run_id")), "left").join(by_run, F.col("_cf_run") == F.col("run_id"), "left")
    made = F.conv(F.substring(F.md5(F.coalesce("run_id", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    how = F.when(F.col("_cf_id").isNotNull(), "id").when(F.col("_cf_run_id").isNotNull(), "run_id").otherwise("inserted")
    return found.withColumns({"id": F.coalesce("_cf_id", "_cf_run_id", made), "found_by": how}).drop("_cf_id", "_cf_run", "_cf_run_id", "claim_compare_run_id")


def save_patents(spark: SparkSession, root: str, records: DataFrame, claims: DataFrame, figures: DataFrame, writer: str | None = None, batch: int = 0) -> int:
    """K1: records upserted by task_id, and their claims and figures replaced, all at once. All three have task_id."""
    tasks = records.select("task_id")
    return commit(spark, root, {"patent_parse_records": Change(records, tasks, "task_id"), "patent_claims": Change(claims, tasks, "task_id"), "patent_figures": Change(figures, tasks, "task_id")}, writer, batch)


def save_comparisons(spark: SparkSession, root: str, runs: DataFrame, results: DataFrame, writer: str | None = None, batch: int = 0) -> int:
    """K4: runs found or inserted (with started_at kept), and their results replaced, in one step. runs has claim_compare_run_id and
    run_id; results has run_id and what the store keeps."""
    stored = _read(spark, root, state(spark, root), "claim_compare_runs")
    if stored is None:
        stored = spark.createDataFrame([], "id long, run_id string")
    known = resolved_runs(stored, runs).drop("found_by")
    ids = known.select("id", F.col("run_id").alias("_cf_run"))
    children = results.join(ids, F.col("_cf_run").eqNullSafe(F.col("run_id"))).withColumnRenamed("id", "claim_compare_run_id").drop("_cf_run", "run_id")
    old = stored.join(ids.select("id").distinct(), "id", "left_semi")
    merged = upserted(old, known.select(*old.columns), ["id"]) if "status" in old.columns else known
    keys = ids.select(F.col("id").alias("claim_compare_run_id"))
    return commit(spark, root, {"claim_compare_runs": Change(merged, ids.select("id"), "id"), "claim_compare_results": Change(children, keys, "claim_compare_run_id")}, writer, batch)
