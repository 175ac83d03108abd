"""Job queue, quota and retention rules as projections over event tables; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fixed values
PACIFIC = "America/Los_Angeles"
NEXT_STAGE = {"coleta": "inferencia", "inferencia": "topicos"}
DAILY, RESERVE, SHARE, SLACK = 10_000, 500, 2_000, 0.7
REAP_MINUTES, MAX_ATTEMPTS = 15, 4
COMMENT_DAYS, RESULT_DAYS, REFRESH_DAYS = 29, 1_095, 25


def quota_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, PACIFIC))


def next_renewal(at: Column) -> Column:
    """Next Pacific midnight, in UTC."""
    return F.to_utc_timestamp(F.date_add(quota_day(at), 1).cast("timestamp"), PACIFIC)


def budget(total: Column, mine: Column) -> Column:
    """Units that a tenant may still spend: what the day allows, and its share or the common slack."""
    slack = F.lit(int(DAILY * SLACK)) - total
    return F.greatest(F.lit(0).cast("long"), F.least(DAILY - RESERVE - total, F.greatest(SHARE - mine, slack)))


def cost(comments: Column, videos: Column, page: int = 100, batch: int = 50) -> Column:
    """Pages of comments, batches of video metadata and one call a video; never above the share."""
    return F.least(F.lit(SHARE).cast("long"), F.ceil(comments / page) + F.ceil(videos / batch) + videos)


def next_stage(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in NEXT_STAGE.items():
        out = F.when(kind == a, b).otherwise(out)
    return out


def claim(jobs: DataFrame, kind: str, now: Column) -> DataFrame:
    """Per kind the oldest pending job that isn't deferred beyond now."""
    open_ = jobs.where((F.col("status") == "pendente") & (F.coalesce("available_at", now) <= now))
    return open_.groupBy(kind).agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """What becomes of jobs stuck in processing: pending again, or the dead-letter table after too many attempts."""
    stuck = jobs.where((F.col("status") == "processando") & (F.coalesce("claimed_at", "created_at") < now - F.expr(f"INTERVAL {REAP_MINUTES} MINUTES")))
    return stuck.withColumn("becomes", F.when(F.col("attempts") > MAX_ATTEMPTS, "dlq").otherwise("pendente"))


def purge_comments(comments: DataFrame, started: str, now: Column) -> DataFrame:
    """Text, author and justification blanked after COMMENT_DAYS; rows stay, so counts stay."""
    old = F.coalesce(F.col(started) < now - F.expr(f"INTERVAL {COMMENT_DAYS} DAYS"), F.lit(False))
    return comments.withColumns({c: F.when(~old, F.col(c)) for c in ("text", "author", "justification") if c in comments.columns})


def purge_results(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that stay: unfinished, or finished within RESULT_DAYS."""
    return runs.where(F.col("completed_at").isNull() | (F.col("completed_at") >= now - F.expr(f"INTERVAL {RESULT_DAYS} DAYS")))


def double_active(runs: DataFrame) -> DataFrame:
    """Models that break the rule of one active run."""
    active = runs.where(F.col("status").isin("pendente", "processando"))
    return active.groupBy("model_id").agg(F.count("*").alias("n")).where("n > 1")


def even_share(limit: Column, wanted: Column) -> Column:
    """Comments taken of each video of an ascending array: an even share of what is left, surplus rolling on."""
    n = F.size(wanted)

    def step(s: Column, x: Column) -> Column:
        parts = n - F.size(s["taken"])
        take = F.least(x, F.ceil(s["left"] / parts))
        return F.struct((s["left"] - take).alias("left"), F.concat(s["taken"], F.array(take)).alias("taken"))

    return F.aggregate(wanted, F.struct(limit.cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken")), step, lambda s: s["taken"])


def accepted(comments: DataFrame, video: str, limit: int, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Comments newest first with the reason of the first filter that drops them (null: accepted), up to limit accepted a video."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(reasons):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    order = W.partitionBy(video).orderBy(F.col("published_at").desc_nulls_last(), "comment_id")
    so_far = F.coalesce(F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return comments.withColumn("reason", reason).withColumn("_before", so_far).where(F.col("_before") < limit).drop("_before")


def blank_metadata(videos: DataFrame, fetched: str, now: Column, columns: list[str]) -> DataFrame:
    """Columns of videos that weren't refreshed for COMMENT_DAYS blanked; rows and counters stay."""
    fresh = F.coalesce(F.col(fetched) >= now - F.expr(f"INTERVAL {COMMENT_DAYS} DAYS"), F.lit(False))
    return videos.withColumns({c: F.when(fresh, F.col(c)) for c in columns})


def refresh_calls(videos: DataFrame, tenant: str, fetched: str, ids: list[str], now: Column, calls: int, batch: int = 50) -> DataFrame:
    """Videos due for a refresh with the call that takes them, oldest first, as far as the tenant's calls reach."""
    due = videos.where(F.col(fetched) < now - F.expr(f"INTERVAL {REFRESH_DAYS} DAYS"))
    place = F.row_number().over(W.partitionBy(tenant).orderBy(fetched, *ids))
    return due.withColumn("_place", place).where(F.col("_place") <= calls * batch).withColumn("call", F.ceil(F.col("_place") / batch)).drop("_place")


def backoff(attempts: Column, key: Column) -> Column:
    """Seconds to wait after so many attempts: a power of two and up to a second more, the same for the same key."""
    jitter = (F.pmod(F.xxhash64(key, attempts), F.lit(999_998)) + 1) / 1_000_000.0
    return F.pow(F.lit(2.0), attempts) + jitter


def plain_int(name: str) -> Column:
    """A JSON value that is a whole number; neither true nor text counts."""
    return F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).try_cast("long"))


def cut(raw: DataFrame, cap: int) -> DataFrame:
    """term, since, the applied limit and warnings of raw cuts (job_id, asked, since, term); what can't be read is left out with a warning."""
    n = plain_int("asked")
    since = F.nullif(F.col("since"), F.lit("")).try_cast("date")
    bad_date = F.when((F.col("since") != "") & since.isNull(), "date")
    limit = F.least(F.coalesce(n, F.lit(cap).cast("long")), F.lit(cap).cast("long"))
    return raw.select("job_id", F.nullif(F.trim("term"), F.lit("")).alias("term"), since.alias("since"), limit.alias("applied"), F.concat_ws(",", bad_date, F.when(n.isNull(), "limit")).alias("warnings"))


def registered(wanted: DataFrame, known: DataFrame | None) -> DataFrame:
    """(version, id) of the versions that aren't known yet, with the ids after the known ones. Versions are few: one task numbers them."""
    last = F.lit(0).cast("long")
    new = wanted.select("version").distinct()
    if known is not None:
        new = new.join(known.select("version"), "version", "left_anti").crossJoin(F.broadcast(known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))))
        last = F.col("_last")
    return new.select("version", (F.row_number().over(W.orderBy("version")) + last).cast("long").alias("id"))


def activated(versions: DataFrame, chosen: Column) -> DataFrame:
    """Exactly the chosen version active."""
    return versions.withColumn("status", F.when(chosen, "ativo").otherwise("arquivado"))
