"""Canonical views over the driver's tables, in Spark and as the SQL that DuckDB runs.

model = region, execution = (region, order year), video = (execution, market segment), comment = line item with its
sentiment from the return flag, topic = part type or brand (a comment has both). Texts come from documents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

SENTIMENTS = ("positive", "neutral", "negative")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Documents dealt evenly where their files make fewer splits than there are cores, as one small file does."""
        d, cores = self.table("documents"), self.spark.sparkContext.defaultParallelism
        return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with model, execution and video; the customer side is small, adaptive execution decides on broadcasting."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        return joined.select(
            "o_orderkey",
            F.col("n_regionkey").cast("long").alias("model_id"),
            (F.col("n_regionkey") * 10000 + F.year("o_orderdate")).cast("long").alias("execution_id"),
            F.col("c_mktsegment").alias("youtube_id"),
            F.col("o_orderdate").alias("published_at"),
            F.floor("o_totalprice").cast("long").alias("views"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        return self.comments_of(self.table("lineitem"))

    def comments_of(self, lines: DataFrame, *more: str) -> DataFrame:
        flag = F.col("l_returnflag")
        sentiment = F.when(flag == "A", "negative").when(flag == "N", "neutral").otherwise("positive")
        return lines.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "model_id", "execution_id", "youtube_id", "published_at", sentiment.alias("sentiment"), F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", *more
        )

    @cached_property
    def topic_links(self) -> DataFrame:
        """(execution_id, topic, sentiment): a comment counts in each of its topics."""
        p = self.table("part").select("p_partkey", F.explode(F.array("p_type", "p_brand")).alias("topic"))
        return self.comments.join(p, F.col("partkey") == F.col("p_partkey")).select("model_id", "execution_id", "topic", "sentiment")

    @cached_property
    def executions(self) -> DataFrame:
        done = self.orders.groupBy("model_id", "execution_id").agg(F.max("published_at").alias("completed_at"))
        return done.withColumn("tenant_id", F.col("model_id") % 2)

    @cached_property
    def texts(self) -> DataFrame:
        return self.texts_of(self.documents)

    @cached_property
    def dealt_texts(self) -> DataFrame:
        """Texts dealt by comment, for what is counted within comments."""
        return self.texts_of(self.table("documents").repartition("doc_id"))

    def texts_of(self, d: DataFrame) -> DataFrame:
        kind = F.col("doc_id") % 7
        return d.select(
            F.col("doc_id").alias("comment_id"), (F.col("doc_id") % 3).alias("execution_id"), F.col("source").alias("video"), "lang", "text",
            F.when(kind < 3, "negative").when(kind < 5, "neutral").otherwise("positive").alias("sentiment"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("job_id"), F.col("user_id").alias("tenant_id"), F.col("ts").cast("timestamp").alias("at"), "event_type",
            F.floor("value").cast("long").alias("units"), "props",
        )


ORDERS_SQL = """orders_v AS (
  SELECT o_orderkey, n_regionkey::BIGINT AS model_id, (n_regionkey * 10000 + year(o_orderdate))::BIGINT AS execution_id,
         c_mktsegment AS youtube_id, o_orderdate AS published_at, floor(o_totalprice)::BIGINT AS views
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
COMMENTS_SQL = ORDERS_SQL + """, comments AS (
  SELECT model_id, execution_id, youtube_id, published_at, l_partkey AS partkey, l_orderkey, l_linenumber,
         CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM lineitem JOIN orders_v ON l_orderkey = o_orderkey)"""
TOPICS_SQL = COMMENTS_SQL + """, topic_links AS (
  SELECT model_id, execution_id, t.topic, sentiment FROM comments
  JOIN (SELECT p_partkey, p_type AS topic FROM part UNION ALL SELECT p_partkey, p_brand FROM part) t ON partkey = t.p_partkey)"""
EXECUTIONS_SQL = """executions AS (
  SELECT model_id, execution_id, max(published_at) AS completed_at, model_id % 2 AS tenant_id FROM orders_v GROUP BY ALL)"""
TEXTS_SQL = """texts AS (
  SELECT doc_id AS comment_id, doc_id % 3 AS execution_id, source AS video, lang, text,
         CASE WHEN doc_id % 7 < 3 THEN 'negative' WHEN doc_id % 7 < 5 THEN 'neutral' ELSE 'positive' END AS sentiment FROM documents)"""


def counts_sql(source: str, keys: str) -> str:
    """Zero-filled sentiment counts of a source, as SQL."""
    each = ", ".join(f"count(*) FILTER (sentiment = '{s}')::BIGINT AS {s}" for s in SENTIMENTS)
    return f"SELECT {keys}, {each}, count(*)::BIGINT AS total FROM {source} GROUP BY ALL"
