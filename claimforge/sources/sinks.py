"""Sinks: idempotent writes of runs and their children (K2-K9); versions.py replaces children (K1, K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_file_name


def append(df: DataFrame, path: str) -> None:
    """K2, K3."""
    df.write.mode("append").parquet(path)


def new_rows(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """K6: rows whose key isn't stored yet."""
    return df.join(stored.select(key).distinct(), key, "left_anti")


def upserted(stored: DataFrame, df: DataFrame, keys: list[str], once: tuple[str, ...] = ("started_at",), always: tuple[str, ...] = ("finished_at",)) -> DataFrame:
    """K4, K5: stored rows with df's values on top; columns in once keep their first value, those in
    always take the new one even if it is null."""
    old = stored.select(*(F.col(c).alias(f"o_{c}") for c in stored.columns))
    on = [df[k].eqNullSafe(old[f"o_{k}"]) for k in keys]
    joined = df.withColumn("_new", F.lit(True)).join(old, on, "full")
    pick = lambda c: F.coalesce(f"o_{c}", c) if c in once else F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"o_{c}")) if c in always else F.coalesce(c, f"o_{c}")
    return joined.select(*(pick(c).alias(c) for c in stored.columns))


def empty_to_null(df: DataFrame) -> DataFrame:
    """K4."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c, kind in df.dtypes if kind == "string"})


def stored_product(df: DataFrame) -> DataFrame:
    """K3: null pictures become empty arrays; a row without payload keeps itself as JSON."""
    return df.withColumns({"picture": F.coalesce("picture", F.array().cast("array<string>")), "raw_payload": F.coalesce("raw_payload", F.to_json(F.struct(*(c for c in df.columns if c != "raw_payload"))))})


def figure_files(df: DataFrame, base_url: str) -> DataFrame:
    """K8: safe name, digest, size and quoted url of figure files (task_id, name, content)."""
    name = safe_file_name(F.col("name"))
    return df.withColumns({"safe_name": name, "file_sha256": F.sha2("content", 256), "file_size": F.length("content"), "figure_url": F.concat(F.lit(f"{base_url}/figures/"), F.url_encode("task_id"), F.lit("/"), F.url_encode(name))})


def text_tables(records: DataFrame, claims: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K7: the three tables with text columns only; sentence units joined by line breaks, types labelled."""
    plain = lambda df: df.select(*(text(F.col(c), kind).alias(c) for c, kind in df.dtypes))

    def text(c: Column, kind: str) -> Column:
        return F.array_join(c, "\n") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")

    named = claims.withColumn("claim_type", F.when(F.col("claim_type") == "INDEPENDENT", "独立权利要求").otherwise("从属权利要求"))
    return plain(records), plain(named), plain(figures)
