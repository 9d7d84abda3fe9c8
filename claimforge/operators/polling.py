"""Status polls of runs and live tasks (T3, T6): batch forms. streaming.polling has the same over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import TERMINAL

#: Failures in a row from which the stored run is read, and at which polling fails.
READ_STORED, GIVE_UP = 5, 12
#: What a poll reports; a success is kept if any of them differs from the last success.
REPORTED = ("status", "claim_compare_run_id", "started_at", "finished_at", "error_message")


def persisted(polls: DataFrame, stored: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("ts", "seq"), reported: tuple[str, ...] = REPORTED) -> DataFrame:
    """What polling keeps of each run: (key, order, action, status).

    polls has key, order, ok and the reported columns; stored has key and status. Action is observed at a success that differs from
    the one before, stored at a failure from the fifth in a row on if a stored run has a status (its status then), and failed
    at the twelfth in a row. A terminal status, observed or stored, ends a run, as does failed; later polls are passed over."""
    rows = Window.partitionBy(key).orderBy(*order)
    rising = rows.rowsBetween(Window.unboundedPreceding, 0)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce("ok", F.lit(False))
    told = F.struct(*reported)
    known = stored.select(F.col(key).alias("_cf_key"), F.col("status").alias("_cf_stored")).dropDuplicates(["_cf_key"])
    # Islands of failures: all polls since a success have its number.
    numbered = polls.join(known, F.col("_cf_key").eqNullSafe(F.col(key)), "left").withColumns({"_cf_island": F.sum(ok.cast("int")).over(rising), "_cf_last": F.last(F.when(ok, told), ignorenulls=True).over(before)})
    failures = F.sum((~ok).cast("int")).over(Window.partitionBy(key, "_cf_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = numbered.withColumn("_cf_failures", F.when(ok, 0).otherwise(failures))
    read = ~ok & (F.col("_cf_failures") >= READ_STORED) & F.coalesce(F.col("_cf_stored") != "", F.lit(False))
    over = F.coalesce(F.when(ok, F.col("status").isin(*TERMINAL)).otherwise((read & F.col("_cf_stored").isin(*TERMINAL)) | (F.col("_cf_failures") >= GIVE_UP)), F.lit(False))
    alive = counted.withColumn("_cf_over", F.max(over).over(before)).filter(~F.coalesce("_cf_over", F.lit(False)))
    action = lambda when, name, status: F.when(when, F.struct(F.lit(name).alias("action"), status.alias("status")))
    made = F.array(
        action(ok & ~told.eqNullSafe(F.col("_cf_last")), "observed", F.col("status")),
        action(read, "stored", F.col("_cf_stored")),
        action(~ok & (F.col("_cf_failures") >= GIVE_UP) & ~(read & F.coalesce(F.col("_cf_stored").isin(*TERMINAL), F.lit(False))), "failed", F.lit("error")),
    )
    return alive.select(key, *order, F.explode(F.array_compact(made)).alias("_cf_made")).select(key, *order, "_cf_made.action", "_cf_made.status")


def shown(stored: Column, live: Column) -> Column:
    """A live task makes a stored status that isn't terminal running."""
    return F.when(F.coalesce(live, F.lit(False)) & stored.isNotNull() & ~stored.isin(*TERMINAL), "running").otherwise(stored)


def live_status(reads: DataFrame, statuses: DataFrame, beats: DataFrame, alive: str = "10 minutes", key: str = "run_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(key, order, status, is_finished) of each read: the last status stored until then, running if the task's last sign of
    life is no older than alive. An as-of join: all three go through one window a run, none is joined by a range."""
    line = lambda df, kind, status: df.select(key, *order, F.lit(kind).alias("kind"), status.alias("stored"))
    none = F.lit(None).cast("string")
    rows = line(statuses, 1, F.col("status")).unionByName(line(beats, 2, none)).unionByName(line(reads, 3, none))
    # At equal places a status comes before a sign of life, and both before a read.
    past = Window.partitionBy(key).orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"stored": F.last("stored", ignorenulls=True).over(past), "beat": F.last(F.when(F.col("kind") == 2, F.col(order[0])), ignorenulls=True).over(past)})
    status = shown(F.col("stored"), F.col("beat") >= F.col(order[0]) - F.expr(f"INTERVAL {alive}"))
    return seen.filter("kind = 3").select(key, *order, status.alias("status"), F.coalesce(status.isin(*TERMINAL), F.lit(False)).alias("is_finished"))
