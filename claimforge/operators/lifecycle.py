"""Run lifecycle from an event log (T1-T3, T6, J26, J29, J30). The clock is always an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import FAILURES, TERMINAL
from ..functions.text import contains_any, strip


def fold(events: DataFrame, keys: list[str], status: str = "status", ts: str = "ts") -> DataFrame:
    """Latest status; started_at is the first time running, completed_at the latest time
    completed or error unless it runs again after that; is_terminal (T3)."""
    is_ = lambda *v: F.col(status).isin(*v)
    agg = events.groupBy(*keys).agg(
        F.max_by(status, ts).alias("status"),
        F.min(F.when(is_("running"), F.col(ts))).alias("started_at"),
        F.max(F.when(is_("completed", "error"), F.col(ts))).alias("ended"),
        F.max(F.when(is_("running"), F.col(ts))).alias("last_running"),
        F.count("*").alias("n_events"),
    )
    open_again = F.col("last_running") > F.col("ended")
    return agg.withColumn("completed_at", F.when(F.coalesce(open_again, F.lit(False)), None).otherwise(F.col("ended"))).withColumn("is_terminal", F.col("status").isin(*TERMINAL)).drop("ended", "last_running")


def changes(events: DataFrame, keys: list[str], status: str = "status", order: str = "ts") -> DataFrame:
    """Only the rows at which the status of a run changes."""
    before = F.lag(status).over(Window.partitionBy(*keys).orderBy(order))
    return events.withColumn("before", before).filter(~F.col(status).eqNullSafe(F.col("before"))).drop("before")


def confirmed(requests: DataFrame, actions: DataFrame, as_of: Column, seconds: int = 30) -> DataFrame:
    """State of keyword confirmations at a time: confirmed with the user's list, waiting while it is
    edited or the deadline lies ahead, else auto_confirmed with the automatic list."""
    acts = actions.groupBy("session_id").agg(F.max_by("action", "ts").alias("action"), F.max_by("keywords", "ts").alias("user_keywords"))
    joined = requests.join(acts, "session_id", "left")
    late = as_of >= F.col("requested_at") + F.make_interval(secs=F.lit(seconds))
    state = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "editing", "waiting_input").when(late, "auto_confirmed").otherwise("waiting_input")
    listed = F.when(F.col("action") == "confirm", F.array_distinct(F.concat("auto_keywords", F.coalesce("user_keywords", F.array().cast("array<string>"))))).otherwise(F.col("auto_keywords"))
    return joined.select("session_id", state.alias("state"), listed.alias("keywords"))


def merged_results(rows: DataFrame, key: str = "session_id", seq: str = "seq", results: str = "results") -> DataFrame:
    """Shallow merge of result maps, later keys win; a null never replaces a value."""
    flat = rows.select(key, seq, F.explode(results).alias("k", "v")).filter("v is not null")
    last = flat.groupBy(key, "k").agg(F.max_by("v", seq).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(results))


def exception_message(message: Column, summary: Column, run_id: Column) -> Column:
    """The message that came, else the summary if it tells of a failure or the run id isn't positive; else null."""
    told = contains_any(summary, FAILURES) | (F.coalesce(run_id <= 0, F.lit(False)) & (strip(summary) != ""))
    return F.coalesce(message, F.when(told, summary))


def error_reports(df: DataFrame) -> DataFrame:
    """K9: texts of error reports cut to their columns' limits."""
    limits = {"message": 4000, "stack": 8000, "details": 20000, "page_url": 1000, "user_agent": 2000}
    return df.withColumns({c: F.left(c, F.lit(n)) for c, n in limits.items() if c in df.columns})
