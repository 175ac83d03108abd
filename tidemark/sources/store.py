"""Tables that queries write and read again: runs replaced whole, remainders appended, snapshots rewritten.

Nothing is changed in place. A run is one partition, replaced by dynamic overwrite; other changes write a new snapshot of the
table beside the old one, so a lost executor or a repeated call leaves either the old or the new state.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the driver and all executors share; of this machine only where the session runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/tables-{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Table:
    """A Parquet table in a shared folder; key, if given, is the column whose values are replaced whole."""

    def __init__(self, spark: SparkSession, key: str | None = None):
        self.spark, self.key, self.root, self.version = spark, key, shared_folder(spark), 0

    @property
    def path(self) -> str:
        return f"{self.root}/v{self.version}"

    def _write(self, df: DataFrame, mode: str, path: str) -> None:
        writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(self.key) if self.key else writer).parquet(path)

    def replace(self, df: DataFrame) -> Table:
        """The runs in df instead of what is there of them; others stay. Doing it again changes nothing."""
        self._write(df.repartition(self.key) if self.key else df, "overwrite", self.path)
        return self

    def append(self, df: DataFrame) -> Table:
        self._write(df, "append", self.path)
        return self

    def append_missing(self, df: DataFrame, *ids: str) -> Table:
        """Rows whose ids aren't there yet: a broken load is taken up where it ended."""
        return self.append(df.join(self.read().select(*ids), list(ids), "left_anti"))

    def rewrite(self, df: DataFrame) -> Table:
        """A new snapshot; df may read the one before."""
        self._write(df, "overwrite", f"{self.root}/v{self.version + 1}")
        self.version += 1
        return self

    def drop(self, which: DataFrame) -> Table:
        """Without the rows whose columns match a row of which."""
        return self.rewrite(self.read().join(which, which.columns, "left_anti"))

    def update(self, changes: DataFrame, on: str) -> Table:
        """Columns of changes put in where ids match; a null change is a change."""
        new = [c for c in changes.columns if c != on]
        told = changes.select(F.col(on), F.struct(*new).alias("_new"))
        now = self.read()
        joined = now.join(told, on, "left")
        return self.rewrite(joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in now.columns]))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def through_csv(df: DataFrame) -> DataFrame:
    """df written as CSV with a header and read again, as strings; quotes, line ends and blanks in texts, empty texts and nulls survive."""
    path = shared_folder(df.sparkSession)
    options = {"header": True, "escape": '"', "nullValue": r"\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)
    return df.sparkSession.read.options(**options, multiLine=True).csv(path)


def through_json(df: DataFrame, schema: str) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.json(path)
    return df.sparkSession.read.schema(schema).json(path)


def through_text(df: DataFrame) -> DataFrame:
    """The single string column of df, a line a row."""
    path = shared_folder(df.sparkSession)
    df.write.text(path)
    return df.sparkSession.read.text(path)


def markdown(columns: list[str]) -> Column:
    """A table row of the columns."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
