"""Reading inputs and the shared folder, alike for every operator of this subpackage."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly where its files make fewer splits than there are cores, as one small file does; else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the session names; a folder of this machine only where the session runs on it alone."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def released(run):
    """run for mapInArrow, after which Arrow's free memory goes back to the system: a worker process stays, idle, beside those of later stages."""

    def then(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return then


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
