"""Transitions of the job queue, as projections of job rows and folds over ordered spending; `now` is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .lifecycle import MAX_ATTEMPTS, next_renewal, next_stage, quota_day

ERROR_LENGTH = 2_000  # fixed value: characters of an error that the dead-letter table keeps


def deferred(jobs: DataFrame, until: Column) -> DataFrame:
    """Jobs put back: pending, not before `until`, with all attempts again."""
    return jobs.withColumns({"status": F.lit("pendente"), "available_at": until, "attempts": F.lit(0).cast("long")})


def attempted(jobs: DataFrame, now: Column) -> DataFrame:
    """Claimed jobs with one attempt more; the budget of attempts is the job's, whatever calls it makes."""
    return jobs.withColumns({"status": F.lit("processando"), "claimed_at": now, "attempts": F.col("attempts") + 1})


def failed(jobs: DataFrame, error: Column) -> DataFrame:
    """Failed jobs: pending again while attempts are left, else a row of the dead-letter table and the end of the run."""
    over = F.col("attempts") >= MAX_ATTEMPTS
    return jobs.select("job_id", "attempts", F.when(over, "dlq").otherwise("pendente").alias("becomes"), F.when(over, F.substring(error, 1, ERROR_LENGTH)).alias("error"))


def completed(jobs: DataFrame, kind: Column) -> DataFrame:
    """What a finished job sets off: a job of the next stage, or the end of its run."""
    nxt = next_stage(kind)
    return jobs.select("job_id", F.when(nxt.isNull(), "run finished").otherwise("job published").alias("event"), nxt.alias("next"))


def quota_gate(jobs: DataFrame, tenant: str, cost: str, at: str, limit: int) -> DataFrame:
    """Jobs in order of (at, job_id) within tenant and Pacific day: run while the day's units suffice, else deferred to the next day without
    an attempt. A job that doesn't fit leaves the units to later, cheaper ones, so this is a fold, not a running sum. A task folds
    sorted rows one by one and holds one number."""
    keyed = jobs.select("job_id", F.col(tenant).cast("long").alias("tenant"), F.col(cost).cast("long").alias("cost"), F.col(at).alias("at"), quota_day(F.col(at)).alias("day"))
    dealt = keyed.repartition("tenant", "day").sortWithinPartitions("tenant", "day", "at", "job_id").select("job_id", "tenant", "day", "cost")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, spent = None, 0
        for b in batches:
            runs = []
            for key, c in zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist()), b.column(3).to_pylist()):
                if key != group:
                    group, spent = key, 0
                runs.append(spent + c <= limit)
                spent += c if runs[-1] else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.bool_())], [*b.schema.names, "runs"])

    gated = dealt.mapInArrow(fold, "job_id long, tenant long, day date, cost long, runs boolean")
    return gated.join(jobs.select("job_id", F.col(at).alias("_at")), "job_id").select("job_id", "tenant", "day", "cost", "runs", F.when(~F.col("runs"), next_renewal(F.col("_at"))).alias("available_at"))


def exhausted(spent: DataFrame, full: DataFrame, limit: int) -> DataFrame:
    """Adjustment rows (day, units) that lift the days which the service called exhausted to the limit."""
    return full.join(spent, "day", "left").select("day", (F.lit(limit) - F.coalesce("units", F.lit(0))).alias("units")).where("units > 0")


def metered(calls: DataFrame, tenant: str, order: list[str], free: Column, budget: int) -> DataFrame:
    """calls with `made`: a call costs one unit unless it is free, and none is made once the budget is spent."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.when(free, 0).otherwise(1)).over(W.partitionBy(tenant).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("made", before < budget)


def recalculation(runs: DataFrame, purged: DataFrame, queued: DataFrame) -> DataFrame:
    """What a request to compute topics anew comes to, run by run: refused where texts are gone or a job waits, else to be queued."""
    p, q = purged.select("execution_id", F.lit(True).alias("_p")).distinct(), queued.select("execution_id", F.lit(True).alias("_q")).distinct()
    reason = F.when(F.col("_p"), "texts purged").when(F.col("_q"), "already queued").otherwise("to queue")
    return runs.join(p, "execution_id", "left").join(q, "execution_id", "left").select("execution_id", reason.alias("outcome"))
