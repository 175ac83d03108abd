"""Samples, splits and folds that depend on row ids alone, so that any partitioning gives the same members."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def order_hash(key: str, seed: int = 42) -> Column:
    """Place of a row in the seeded order. md5 keeps it expressible in SQL elsewhere."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def cochran_size(population: Column, margin: float = 0.05, z: float = 1.96, p: float = 0.5) -> Column:
    """cochran() of a column of population sizes."""
    n0 = z * z * p * (1 - p) / (margin * margin)
    return F.ceil(F.lit(n0) / (1 + F.lit(n0 - 1) / population)).cast("long")


def cochran(population: int, margin: float = 0.05, z: float = 1.96, p: float = 0.5) -> int:
    """Sample size with finite-population correction."""
    n0 = z * z * p * (1 - p) / (margin * margin)
    return math.ceil(n0 / (1 + (n0 - 1) / population))


def numbered(rows: DataFrame, strata: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """rows with place (from 1) within their stratum by bucket, then order, and the stratum's size.

    Rows are dealt and sorted by stratum and bucket, and a bucket starts where the counts of those before it end. So a huge stratum is
    numbered by as many tasks as it has buckets; only a row a bucket is summed up in one task. The bucket must rise with the order."""
    keyed = rows.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    own = W.partitionBy(*strata)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_n").over(own).alias("_size"))
    met = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, s in enumerate(strata):
        met = met & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    placed = keyed.withColumn("_place", F.row_number().over(W.partitionBy(*strata, "_bucket").orderBy(*order))).join(starts, met)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_place")).alias("place"), F.col("_size").alias("size"))


def within(rows: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """rows with place (from 1) within their stratum in seeded order, and the stratum's size. The first four digits of the order's hash deal
    a stratum to 65,536 buckets."""
    order = order_hash(key, seed)
    return numbered(rows, [stratum], F.substring(order, 1, 4), [order, F.col(key)])


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, one of each stratum a round while it lasts: a global top n by (round, stratum)."""
    return within(rows, stratum, key, seed).orderBy("place", stratum).limit(n)


def split(rows: DataFrame, stratum: str, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Side of each row: the first round(size * share) of each stratum validate, halves to even."""
    out = within(rows, stratum, key, seed)
    return out.withColumn("side", F.when(F.col("place") <= F.bround(F.col("size") * F.lit(share)), "validation").otherwise("train"))


def folds(rows: DataFrame, stratum: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold of each row: dealt in turn within strata, a stratum starting where the one before it ended."""
    out = within(rows, stratum, key, seed)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))  # a row a stratum
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy(stratum).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return out.join(F.broadcast(starts), stratum).withColumn("fold", ((F.col("_start") + F.col("place") - 1) % k).cast("int")).drop("_start")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """N / (k * n) of each class."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all").cast("double") / (F.col("_k") * F.col("n"))).alias("weight"))
