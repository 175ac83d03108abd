"""Rules on hand-made rows: ties, margins, minimums, zero fill, nulls."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A, evaluation as E, facts as X, lifecycle as L, sampling as S, windows as N

CLASSES = ("negative", "neutral", "positive")


def counts(spark, rows, keys="execution_id long, youtube_id string"):
    return spark.createDataFrame(rows, f"{keys}, positive long, neutral long, negative long, total long")


def test_reach_counts_at_two_grains(spark):
    videos = spark.createDataFrame([(1, 10_000, 500), (1, 5_000, 100), (2, 0, 0)], "k long, views long, likes long")
    comments = spark.createDataFrame([(1,)] * 6, "k long")
    got = {r.k: (r.views, r.likes, r.comments, r.per_thousand_views) for r in A.reach(videos, comments, "k").collect()}
    assert got == {1: (15_000, 600, 6, 0.4), 2: (0, 0, 0, 0.0)}


def test_empty_groups_stay(spark):
    spine = spark.createDataFrame([(1,), (2,)], "execution_id long")
    c = A.distribution(spark.createDataFrame([(1, "negative")], "execution_id long, sentiment string"), "execution_id")
    assert sorted(map(tuple, A.with_empty(spine, c, ["execution_id"]).collect())) == [(1, 0, 0, 1, 1), (2, 0, 0, 0, 0)]


def test_majority_is_null_on_ties(spark):
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "i long, l string")
    assert sorted((r.i, r.majority) for r in A.majority(votes, "i", "l").collect()) == [(1, "a"), (2, None)]


def test_margin_is_strict_and_minimums_hold(spark):
    runs = spark.createDataFrame([(1, 1, "2024-01-01", 50, 0, 50, 100), (1, 2, "2024-02-01", 30, 0, 70, 100), (1, 3, None, 1, 0, 9, 10)], "model_id long, execution_id long, completed_at string, positive long, neutral long, negative long, total long")
    got = X.sentiment_shift(runs, X.Thresholds()).collect()
    assert [(r.before_execution_id, r.execution_id, r.difference) for r in got] == [(1, 2, 20.0)]
    half = math.sqrt(0.25 / 100 + 0.21 / 100)
    assert X.sentiment_shift(runs, X.Thresholds(z=0.2 / half + 1e-9)).collect() == []


def test_topic_extreme_ties_go_to_the_smaller_name(spark):
    t = counts(spark, [(1, "b", 10, 0, 30, 40), (1, "a", 10, 0, 30, 40), (1, "c", 0, 0, 20, 20)], "execution_id long, topic string")
    r = spark.createDataFrame([(1, 60, 40, 100, 200)], "execution_id long, positive long, neutral long, negative long, total long")
    assert [(x.topic, x.percent, x.run_percent) for x in X.topic_extreme(t, r, "negative", X.Thresholds()).collect()] == [("a", 75.0, 50.0)]


def test_concentration_counts_all_topics(spark):
    t = counts(spark, [(1, "a", 0, 0, 60, 60), (1, "b", 0, 0, 40, 40), (1, "c", 5, 0, 0, 5), (1, "d", 5, 0, 0, 5)], "execution_id long, topic string")
    got = X.concentrated(t, X.Thresholds()).collect()
    assert [(r.pointed, r.topics, r.percent, r.labels) for r in got] == [(1, 4, 60.0, "a")]


def test_numbers_and_half_even(spark):
    one = spark.range(1)
    assert one.select(X.number_pt(F.lit(12.5)), X.number_pt(F.lit(7.0)), X.points(F.lit(0.1225))).first()[:] == ("12,5", "7", 12.2)
    with pytest.raises(ValueError):
        X.Thresholds(video_multiple=1.0)


def test_low_median(spark):
    rows = [(1, "negative", i, "x" * n) for i, n in enumerate((5, 1, 3, 9))] + [(1, "positive", 9, "x")]
    df = spark.createDataFrame(rows, "execution_id long, sentiment string, comment_id long, text string")
    assert sorted((r.sentiment, r.comment_id) for r in N.median_representative(df, "execution_id").collect()) == [("negative", 2), ("positive", 9)]


def test_published_fleiss(spark):
    """Fleiss 1971: 30 subjects, 6 raters, 5 categories would give 0.43; here the 10 x 5 example of 14 raters, 0.210."""
    rows = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]
    votes = spark.createDataFrame([(*r, 14) for r in rows], "a long, b long, c long, d long, e long, raters long")
    assert E.fleiss(votes, tuple("abcde")).first().kappa == pytest.approx(0.2099, abs=1e-3)


def test_cohen_and_degenerate(spark):
    pairs = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    assert E.cohen(spark.createDataFrame(pairs, "a string, b string"), "a", "b", ("y", "n")).first().kappa == pytest.approx(0.4)
    same = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
    assert E.cohen(same, "a", "b", ("y", "n")).first().kappa is None


def test_macro_divides_by_all_classes(spark):
    pairs = spark.createDataFrame([("positive", "positive")] * 4, "g string, p string")
    assert E.macro(E.prf(pairs, "g", "p", CLASSES)).first().macro_f1 == pytest.approx(1 / 3)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("s"))
    for f in (lambda d: S.split(d, "s", "id").select("id", "side"), lambda d: S.folds(d, "s", "id").select("id", "fold"), lambda d: S.round_robin(d, "s", "id", 31).select("id")):
        assert sorted(map(tuple, f(df.repartition(7)).collect())) == sorted(map(tuple, f(df.coalesce(1)).collect()))
    fold = S.folds(df, "s", "id").groupBy("fold").count().collect()
    assert {r["count"] for r in fold} == {60} and S.cochran(2534) == 334


def test_budget_share_and_even_share(spark):
    one = spark.range(1)
    got = one.select(L.budget(F.lit(0), F.lit(0)), L.budget(F.lit(9_600), F.lit(0)), L.budget(F.lit(8_000), F.lit(1_999)), L.even_share(F.lit(100), F.array(*map(F.lit, (10, 20, 500))).cast("array<bigint>"))).first()
    assert got[:3] == (7_000, 0, 1) and got[3] == [10, 20, 70]


def test_renewal_over_daylight_saving(spark):
    at = F.lit("2024-03-10 12:00:00").cast("timestamp")
    assert str(spark.range(1).select(L.next_renewal(at)).first()[0]) == "2024-03-11 07:00:00"


def test_purge_keeps_rows(spark):
    df = spark.createDataFrame([(1, "t", "2024-01-01"), (2, "t", "2024-03-01"), (3, "t", None)], "id long, text string, s string").withColumn("s", F.col("s").cast("timestamp"))
    got = {r.id: r.text for r in L.purge_comments(df, "s", F.lit("2024-03-02").cast("timestamp")).collect()}
    assert got == {1: None, 2: "t", 3: "t"}


def test_first_filter_takes_the_blame(spark):
    df = spark.createDataFrame([(1, "v", 5, "ab"), (2, "v", 4, "xb"), (3, "v", None, "a"), (4, "v", 3, "a"), (5, "v", 2, "a")], "comment_id long, video string, published_at int, text string")
    got = L.accepted(df, "video", 2, [("date", F.col("published_at").isNull()), ("term", ~F.col("text").contains("a"))])
    assert {r.comment_id: r.reason for r in got.collect()} == {1: None, 2: "term", 4: None}


def test_admitted_counts_what_is_large_enough(spark):
    def frame(rows, name):
        return spark.createDataFrame(rows, f"execution_id long, {name} string, total long")

    runs = spark.createDataFrame([(1, 100), (2, 99)], "execution_id long, total long")
    topics = frame([(1, "a", 30), (1, "b", 29), (1, "c", 31)], "topic")
    got = X.admitted(runs, topics, frame([(1, "v", 30), (2, "w", 3)], "youtube_id"), X.Thresholds())
    rows = {r.execution_id: (r.run_enough, r.compared_enough, r.topics_enough, r.videos_enough) for r in got.collect()}
    assert rows == {1: (True, True, 2, 1), 2: (False, False, 0, 0)}
