"""Stored tables laid out for lookups by key (S12): buckets and order by the key, bloom filters on it.

A lookup of keys reads the buckets they fall in, and of those the row groups that may hold them; tables bucketed alike by the key they
share join without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def store(df: DataFrame, name: str, key: str, path: str, buckets: int = BUCKETS, others: Sequence[str] = ()) -> DataFrame:
    """Writes df as the table name at path; others are further columns with bloom filters."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    for c in (key, *others):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def found(spark: SparkSession, name: str, key: str, values: Sequence) -> DataFrame:
    """Rows of a few keys, in order of the key: only their buckets are read."""
    return spark.table(name).filter(F.col(key).isin(list(values))).orderBy(key)


def with_children(spark: SparkSession, parents: str, children: str, key: str, values: Sequence | None = None) -> DataFrame:
    """Parents with their children by the key both tables are bucketed by."""
    left, right = spark.table(parents), spark.table(children)
    if values is not None:
        left, right = left.filter(F.col(key).isin(list(values))), right.filter(F.col(key).isin(list(values)))
    return left.join(right.hint("merge"), key)
