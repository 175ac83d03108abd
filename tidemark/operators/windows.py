"""Window picks: representatives, order of runs, cumulative shares, rate rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def topic_representative(links: DataFrame, topic: str, min_length: int = 40) -> DataFrame:
    """Per topic the comment long enough, then with most weight, then smallest id."""
    order = W.partitionBy(topic).orderBy(F.when(F.length("text") >= min_length, 0).otherwise(1), F.desc("weight"), "comment_id")
    return links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def median_representative(comments: DataFrame, *keys: str) -> DataFrame:
    """Per keys and sentiment the comment of low median length, found with integers only."""
    w = W.partitionBy(*keys, "sentiment")
    ranked = comments.withColumn("_pos", F.row_number().over(w.orderBy(F.length("text"), "comment_id"))).withColumn("_n", F.count("*").over(w))
    return ranked.where((2 * F.col("_pos")).isin(F.col("_n"), F.col("_n") + 1)).drop("_pos", "_n")


def run_order(model: str = "model_id", at: str = "completed_at", run: str = "execution_id"):
    """Runs of a model by completion, unfinished ones last."""
    return W.partitionBy(model).orderBy(F.col(at).asc_nulls_last(), run)


def consecutive(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Each run with the columns of the run before it, as before_<column>; the first run of a model is left out."""
    prev = F.lag(F.struct(*columns)).over(run_order())
    out = runs.withColumn("_before", prev).where("_before is not null")
    return out.select(*runs.columns, *[F.col(f"_before.{c}").alias(f"before_{c}") for c in columns])


def concentration(counts: DataFrame, group: str, key: str, value: str, target: float) -> DataFrame:
    """Fewest keys, largest first, whose values reach the target share of the group's total."""
    total = F.sum(value).over(W.partitionBy(group))
    before = F.coalesce(F.sum(value).over(W.partitionBy(group).orderBy(F.desc(value), key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = counts.withColumn("_total", total).withColumn("_before", before)
    return out.where((F.col("_total") > 0) & (F.col("_before") < F.col("_total") * target)).drop("_total", "_before")


def nth_within(events: DataFrame, key: str, at: str, n: int, seconds: int) -> DataFrame:
    """Events that are the n-th of their key within so many seconds."""
    earlier = F.lag(at, n - 1).over(W.partitionBy(key).orderBy(at, "job_id"))
    return events.withColumn("_first", earlier).where(F.col(at).cast("double") - F.col("_first").cast("double") <= seconds).drop("_first")


def trailing_count(events: DataFrame, key: str, at: str, seconds: int) -> Column:
    """Number of events of the key in the seconds up to and with this one."""
    return F.count("*").over(W.partitionBy(key).orderBy(F.col(at).cast("long")).rangeBetween(-seconds, 0))


def first_of(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
