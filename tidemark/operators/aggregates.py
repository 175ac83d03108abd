"""Distributions, reach, boards and other grouped reports over runs, videos, comments and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SENTIMENTS = ("positive", "neutral", "negative")


def distribution(comments: DataFrame, *keys: str) -> DataFrame:
    """Counts of the closed set of sentiments, zero-filled, and their total. One aggregation, combined before the shuffle."""
    return comments.groupBy(*keys).agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS], F.count("*").alias("total"))


def fraction(part: Column | str, whole: Column | str) -> Column:
    """Share of part in whole, 0 where whole is 0."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def reach(videos: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Views and likes at video grain, comments at comment grain, and comments per thousand views; joined after both are counted."""
    v = videos.groupBy(key).agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"))
    c = comments.groupBy(key).agg(F.count("*").alias("comments"))
    n = F.coalesce("comments", F.lit(0))
    rate = F.coalesce(F.bround(F.try_divide(n.cast("double"), F.col("views") / F.lit(1000.0)), 2), F.lit(0.0))
    return v.join(c, key, "left").select(key, "views", "likes", n.alias("comments"), rate.alias("per_thousand_views"))


def with_empty(spine: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts for every row of spine, zeros where nothing was counted."""
    return spine.join(counts, keys, "left").select(*spine.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*SENTIMENTS, "total")])


def available_results(executions: DataFrame, comments: DataFrame, videos: DataFrame, topics: DataFrame) -> DataFrame:
    """Completed runs with distribution and numbers of videos and topics, zeros where there are none."""
    out = executions.where("completed_at is not null")
    out = with_empty(out.select("tenant_id", "model_id", "execution_id", "completed_at"), distribution(comments, "execution_id"), ["execution_id"])
    for name, df in (("videos", videos), ("topics", topics)):
        out = out.join(df.groupBy("execution_id").agg(F.count("*").alias(name)), "execution_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def most_used(rows: DataFrame, group: str, version: str, at: str) -> DataFrame:
    """Per group the version with most rows, smallest of equals, and its first time."""
    n = rows.groupBy(group, version).agg(F.count("*").alias("n"), F.min(at).alias("first_at"))
    best = n.groupBy(group).agg(F.max_by(F.struct(version, "n", "first_at"), F.struct("n", -F.col(version))).alias("b"))
    return best.select(group, "b.*")


def majority(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Label with strictly most votes, null on a tie."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    top = n.groupBy(item).agg(F.max("n").alias("top"), F.max_by(label, "n").alias("best"), F.collect_list("n").alias("all"))
    unique = F.size(F.filter("all", lambda x: x == F.col("top"))) == 1
    return top.select(item, F.when(unique, F.col("best")).alias("majority"), F.col("top").alias("votes"))


def confusion(pairs: DataFrame, gold: str, predicted: str, classes: tuple[str, ...]) -> DataFrame:
    """Matrix row for every class, counts per predicted class, zeros kept."""
    spark = pairs.sparkSession
    spine = spark.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("gold"))
    n = pairs.groupBy(F.col(gold).alias("gold")).agg(*[F.count_if(F.col(predicted) == c).alias(f"as_{c}") for c in classes])
    return F.broadcast(spine).join(n, "gold", "left").select("gold", *[F.coalesce(f"as_{c}", F.lit(0)).alias(f"as_{c}") for c in classes])


def divergence(ratings: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Symmetric counts of label pairs over all rater pairs; the diagonal counts once."""
    a, b = ratings.alias("a"), ratings.alias("b")
    pairs = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{rater}") < F.col(f"b.{rater}")))
    pairs = pairs.select(F.col(f"a.{label}").alias("x"), F.col(f"b.{label}").alias("y"))
    both = pairs.union(pairs.where("x <> y").select("y", "x"))
    return both.groupBy("x", "y").agg(F.count("*").alias("n"))


def daily_quota(spend: DataFrame, day: str, tenant: str, units: str, first: str, last: str) -> DataFrame:
    """Units of every day from first to last, days without spending included."""
    spine = spend.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    used = spend.groupBy(F.col(day).alias("day")).agg(F.sum(units).alias("units"), F.count_distinct(tenant).alias("tenants"))
    return F.broadcast(spine).join(used, "day", "left").select("day", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("tenants", F.lit(0)).alias("tenants"))


def word_concentration(words: DataFrame, group: str, video: str, comment: str, word: str) -> DataFrame:
    """Per word: comments with it, share of its top video, that video (smallest of equals)."""
    n = words.select(group, video, comment, word).distinct().groupBy(group, word, video).agg(F.count("*").alias("n"))
    return n.groupBy(group, word).agg(
        F.sum("n").alias("comments"), F.max("n").alias("top"), F.min_by(video, F.struct(-F.col("n"), F.col(video))).alias("dominant")
    ).withColumn("concentration", fraction("top", "comments"))


def lexicon_index(entries: DataFrame, key: str, polarity: str) -> DataFrame:
    """One polarity a key; keys with different polarities are left out."""
    return entries.groupBy(key).agg(F.min(polarity).alias("polarity"), F.max(polarity).alias("_max")).where("polarity = _max").drop("_max")


def spelling_mode(words: DataFrame, key: str, form: str) -> DataFrame:
    """Most frequent form of a key, alphabetically first of equals."""
    n = words.groupBy(key, form).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(form, F.struct(-F.col("n"), F.col(form))).alias(form), F.sum("n").alias("occurrences"))


def index_percentiles(rows: DataFrame, group: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """Percentiles by index min(n - 1, p * n // 100) of the sorted values, for each group."""
    w = W.partitionBy(group)
    ranked = rows.select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n") / 100)), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(group).agg(F.count("*").alias("n"), *picks)


def histogram(rows: DataFrame, value: str, width: float, buckets: int) -> DataFrame:
    """Rows per bucket of the given width, the last one closed, empty ones kept."""
    spine = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    n = rows.groupBy(F.least(F.floor(F.col(value) / width), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
