"""Streaming forms of the queue and rate rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class RateLimit(StatefulProcessor):
    """Accepted times of a key as list state, at most `most` of them. A timer clears a key once its last accepted event has left the window,
    so idle keys cost nothing; busy ones stream through."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [x[0] for x in self.kept.get()] if self.kept.exists() else []
        for f in rows:
            out = []
            for t, event in sorted(zip(f["at"].tolist(), f["event"].tolist(), strict=True)):
                kept = [x for x in kept if x > t - self.seconds]
                ok = len(kept) < self.most
                wait = 0.0 if ok else kept[0] + self.seconds - t
                if ok:
                    kept.append(t)
                out.append((key[0], event, t, ok, wait))
            yield pd.DataFrame(out, columns=["key", "event", "at", "allowed", "wait"])
        self.kept.put([(x,) for x in kept])
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int(1000 * (kept[-1] + self.seconds)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "event": pd.Series(dtype="int64"), "at": pd.Series(dtype=float), "allowed": pd.Series(dtype=bool), "wait": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, key: str, at: str, event: str, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Verdict on each event of a key: refused if `most` accepted ones lie within the window before it. Refused events
    don't count, which a window aggregate cannot say, so the accepted times are kept as state. Events of a micro-batch are taken by
    (time, event), those later than the watermark allows are left out; the state store must be one that allows timers (set_store())."""
    time = F.timestamp_micros((F.col(at).cast("double") * 1_000_000).cast("long"))
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at"), F.col(event).cast("long").alias("event"), time.alias("time")).withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(
        RateLimit(most, seconds), "key string, event long, at double, allowed boolean, wait double", "Append", "EventTime"
    )


def set_store(spark: SparkSession) -> None:
    """The state store that list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per kind in event-time windows, with a watermark; an extension, the reference rules have no event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))


def apply_transitions(jobs_path: str):
    """foreachBatch writer that keeps the latest state of each job of a micro-batch, in a folder of the epoch.

    Spark may run an epoch again after a failure. It has the same rows then, and its folder is overwritten, so a repeated epoch changes
    nothing; current() reads the state over all epochs."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("job_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max(F.struct("at", "event_id")).alias("last"))
        latest.select("job_id", "status", "last.at", "last.event_id").write.mode("overwrite").parquet(f"{jobs_path}/epoch={epoch}")

    return write


def current(spark: SparkSession, jobs_path: str) -> DataFrame:
    """The latest state of each job over all epochs: late events of a job don't undo later ones."""
    every = spark.read.parquet(jobs_path)
    return every.groupBy("job_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"))


def claims(jobs_path: str, kind: str):
    """foreachBatch writer that claims the head of each kind's queue once a micro-batch: the oldest pending job of those known so far that no
    epoch before has claimed. What an epoch claims depends on earlier epochs alone, so doing it again claims the same jobs."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        root, schema = f"{jobs_path}/pending", f"job_id long, {kind} string, at double, epoch long"
        batch.select("job_id", F.col(kind).cast("string").alias(kind), F.col("at").cast("double").alias("at")).write.mode("overwrite").parquet(f"{root}/epoch={epoch}")
        known = spark.read.schema(schema).parquet(root).where(F.col("epoch") <= epoch)
        head = known
        if epoch:
            taken = spark.read.schema("job_id long, " + f"{kind} string, epoch long").parquet(f"{jobs_path}/claimed").where(F.col("epoch") < epoch)
            head = known.join(taken.select("job_id"), "job_id", "left_anti")
        first = head.groupBy(kind).agg(F.min_by("job_id", F.struct("at", "job_id")).alias("job_id"))
        first.select("job_id", kind).write.mode("overwrite").parquet(f"{jobs_path}/claimed/epoch={epoch}")

    return write
