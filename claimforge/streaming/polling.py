"""Status polls and live tasks over streams (T3, T6), equal to operators.polling, and exactly-once upserts (K5, K6).

Polls need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import TERMINAL
from ..operators.polling import GIVE_UP, READ_STORED, REPORTED, shown
from ..sources import versions
from ..sources.sinks import upserted

# The processor travels with the job, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ladder(StatefulProcessor):
    """State of a run: the last success, failures in a row, the stored status (first from the initial state), and whether it is over.

    A run that is silent for longer than a poll may take counts a failed poll by its timer, if silence (ms) is given."""

    def __init__(self, key: str, order: tuple[str, ...], reported: tuple[str, ...], silence: int | None, ladder: tuple[int, int, tuple[str, ...]]):
        self.key, self.order, self.reported, self.silence = key, order, reported, silence
        self.read_stored, self.give_up, self.terminal = ladder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "told array<string>")
        self.failures = handle.getValueState("failures", "n int")
        self.stored = handle.getValueState("stored", "status string")
        self.over = handle.getValueState("over", "is_over boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for status in initialState["status"]:
            if status is not None:
                self.stored.update((status,))

    def _failed(self) -> list[tuple[str, str | None]]:
        n = (self.failures.get()[0] if self.failures.exists() else 0) + 1
        self.failures.update((n,))
        out = []
        if n >= self.read_stored and self.stored.exists() and self.stored.get()[0]:
            status = self.stored.get()[0]
            out.append(("stored", status))
            if status in self.terminal:
                self.over.update((True,))
                return out
        if n >= self.give_up:
            out.append(("failed", "error"))
            self.over.update((True,))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        if self.over.exists():
            return
        polls = pd.concat(list(rows)).sort_values(list(self.order), kind="stable")
        out = []
        for poll in polls.itertuples(index=False):
            if self.over.exists():
                break
            if poll.ok is True or poll.ok == 1:
                self.failures.clear()
                told = [None if pd.isna(v) else str(v) for v in (getattr(poll, c) for c in self.reported)]
                if not self.last.exists() or list(self.last.get()[0]) != told:
                    out.append((poll, "observed", None if pd.isna(poll.status) else poll.status))
                self.last.update((told,))
                if poll.status in self.terminal:
                    self.over.update((True,))
            else:
                out += [(poll, *made) for made in self._failed()]
        if self.silence:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not self.over.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        if out:
            yield pd.DataFrame([(key[0], *(getattr(p, c) for c in self.order), action, status) for p, action, status in out], columns=[self.key, *self.order, "action", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.over.exists():
            return
        made = self._failed()
        if not self.over.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        if made:
            yield pd.DataFrame([(key[0], *(None for _ in self.order), *m) for m in made], columns=[self.key, *self.order, "action", "status"])

    def close(self) -> None:
        pass


def persisted_polls(polls: DataFrame, stored: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("ts", "seq"), reported: tuple[str, ...] = REPORTED, silence: int | None = None) -> DataFrame:
    """Operators.polling.persisted over a stream of polls that come in order; stored is a batch table, read when the query first starts."""
    types = dict(polls.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *order)) + ", action string, status string"
    ladder = Ladder(key, order, reported, silence, (READ_STORED, GIVE_UP, TERMINAL))
    first = stored.select(F.col(key).cast(types[key]).alias(key), "status").groupBy(key)
    # As text, a number looks the same whether or not others beside it are null.
    text = polls.withColumns({c: F.col(c).cast("string") for c in reported})
    return text.groupBy(key).transformWithStateInPandas(ladder, schema, "append", "ProcessingTime" if silence else "None", initialState=first)


def live_status(statuses: DataFrame, beats: DataFrame, alive: str = "10 minutes", late: str = "10 minutes", key: str = "run_id") -> DataFrame:
    """T3 over two streams: each status as it is shown when it comes in, running if the task gave a sign of life (key, ts) in the
    alive time up to it. An interval join; watermarks bound what either side keeps. Signs of life are thinned to one a minute before."""
    left = statuses.withWatermark("ts", late)
    minute = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 60) * 60)
    right = beats.select(F.col(key).alias("_cf_key"), minute.alias("_cf_beat")).withWatermark("_cf_beat", late).dropDuplicatesWithinWatermark(["_cf_key", "_cf_beat"])
    near = (left[key] == right["_cf_key"]) & (right["_cf_beat"] <= left["ts"]) & (right["_cf_beat"] >= left["ts"] - F.expr(f"INTERVAL {alive}"))
    joined = left.join(right, near, "left_outer").drop("_cf_key")
    once = joined.withColumn("status", shown(F.col("status"), F.col("_cf_beat").isNotNull())).drop("_cf_beat")
    return once.dropDuplicates(left.columns)


def upsert_stream(stream: DataFrame, root: str, name: str, checkpoint: str, key: str = "run_id", seq: str = "seq", once: tuple[str, ...] = ("started_at",), always: tuple[str, ...] = ("finished_at",)):
    """K5, K6: rows of a stream merged into a table of a versioned store, each batch once: its number is part of the commit, so a batch
    that is played again changes nothing. Of rows of a key in one batch the later ones by seq come on top. Returns the started query."""
    return stream.writeStream.foreachBatch(merger(root, name, checkpoint, key, seq, once, always)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merger(root: str, name: str, writer: str, key: str, seq: str, once: tuple[str, ...], always: tuple[str, ...]):
    """What upsert_stream does with a batch and its number."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = lambda c: F.when(F.col(c).isNotNull(), F.col(seq))
        last = lambda c: F.min_by(c, there(c)) if c in once else F.max_by(c, seq if c in always else there(c))
        new = batch.groupBy(key).agg(*(last(c).alias(c) for c in batch.columns if c not in (key, seq)))
        stored = versions.read(spark, root, name, ", ".join(f"`{c}` {kind}" for c, kind in new.dtypes))
        old = stored.join(new.select(key), key, "left_semi")
        rows = upserted(old, new.select(*old.columns), [key], once, always)
        versions.commit(spark, root, {name: versions.Change(rows, new.select(key), key)}, writer=writer, batch=number)

    return merge
