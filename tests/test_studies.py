"""Resamples, tables that are written and read, folds over spending, classifiers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import aggregates as A, evaluation as E, jobs as J, lifecycle as L, selection as ML
from tidemark.sources import files
from tidemark.sources.store import Table, through_csv

CLASSES = ("negative", "neutral", "positive")


def labelled(spark, n=300):
    rows = [(i, CLASSES[i % 3], CLASSES[(i + (i % 5 == 0)) % 3], CLASSES[(i + (i % 3 == 0)) % 3], CLASSES[i * 7 % 11 % 3]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, gold string, a string, b string, weak string")


def macro(pairs):
    out = 0
    for c in CLASSES:
        tp, both = sum(w for g, p, w in pairs if g == p == c), sum(w * ((g == c) + (p == c)) for g, p, w in pairs)
        out += 2 * tp / both if both else 0
    return out / 3


def test_paired_bootstrap(spark):
    rows, df = labelled(spark)
    got = [E.bootstrap_paired(df.repartition(p), "gold", "a", "b", CLASSES, resamples=400).first() for p in (1, 5)]
    assert got[0] == got[1]  # whatever the partitioning
    delta = macro([(g, a, 1) for _, g, a, _, _ in rows]) - macro([(g, b, 1) for _, g, _, b, _ in rows])
    assert got[0].delta == pytest.approx(delta) and got[0].low < delta < got[0].high and got[0].resamples == 400


def test_bootstrap_within_strata(spark):
    rows, df = labelled(spark)
    size = {"negative": 1000, "neutral": 50, "positive": 500}
    population = spark.createDataFrame(list(size.items()), "weak string, N long")
    got = E.bootstrap_strata(df, "gold", "a", CLASSES, "weak", population, resamples=300).first()
    n = {c: sum(r[4] == c for r in rows) for c in CLASSES}
    assert got.macro_f1 == pytest.approx(macro([(g, a, size[w] / n[w]) for _, g, a, _, w in rows])) and got.low < got.macro_f1 < got.high


def test_tables(spark):
    run = lambda k, *v: spark.createDataFrame([(k, x) for x in v], "run long, v long")
    t = Table(spark, "run").replace(run(1, 1, 2).union(run(2, 3)))
    t.replace(run(1, 9)).replace(run(1, 9))
    assert sorted((r.run, r.v) for r in t.read().collect()) == [(1, 9), (2, 3)]
    t.drop(spark.createDataFrame([(1,)], "run long"))
    assert [(r.run, r.v) for r in t.read().collect()] == [(2, 3)]
    u = Table(spark).append(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    u.append_missing(spark.createDataFrame([(2, "z"), (3, "c")], "id long, x string"), "id").update(spark.createDataFrame([(1, None), (3, "d")], "id long, x string"), "id")
    assert sorted((r.id, r.x) for r in u.read().collect()) == [(1, None), (2, "b"), (3, "d")]


def test_csv_keeps_texts(spark):
    texts = [None, 'a "quoted", text', "two\nlines", "  blanks  ", "", "back\\slash"]
    back = through_csv(spark.createDataFrame(list(enumerate(texts)), "id long, x string"))
    assert [r.x for r in back.orderBy(F.col("id").cast("long")).collect()] == texts


def test_gate_leaves_units_to_cheaper_jobs(spark):
    jobs = spark.createDataFrame([(i, 1, c, f"2024-05-01 1{i}:00:00") for i, c in enumerate((50, 30, 10, 5, 40))] + [(9, 2, 100, "2024-05-01 12:00:00")], "job_id long, t long, c long, s string").withColumn("at", F.to_timestamp("s"))
    got = {r.job_id: r for r in J.quota_gate(jobs.repartition(3), "t", "c", "at", 65).collect()}
    assert [got[i].runs for i in (0, 1, 2, 3, 4, 9)] == [True, False, True, True, False, False]
    assert str(got[1].available_at) == "2024-05-02 07:00:00" and got[0].available_at is None


def test_lookup_shows_empty_rows(spark):
    spine = spark.createDataFrame([(1, "a"), (1, "b")], "execution_id long, youtube_id string")
    counts = A.distribution(spark.createDataFrame([(1, "a", "negative")], "execution_id long, youtube_id string, sentiment string"), "execution_id", "youtube_id")
    assert sorted((r.youtube_id, r.total) for r in A.with_empty(spine, counts, ["execution_id", "youtube_id"]).collect()) == [("a", 1), ("b", 0)]


def test_classifier_is_chosen_once_by_version(spark):
    words = lambda x: pd.DataFrame({"label": ["l"] * len(x), "justification": x.astype(str)})
    d = spark.createDataFrame([("one",)], "text string")
    pick = lambda v: ML.classify(d, "text", [None, ML.Classifier("old", 1, words), ML.Classifier("new", 2, words)], v)
    assert [pick(v).first().classifier for v in (1, 2)] == ["old", "new"]
    with pytest.raises(ValueError):
        pick(3)


def test_words_of_emoji():
    assert T.replace_emoji("a👍🏽b") == "a positivo b" and T.replace_emoji("🇧🇷x☂️") == " bandeira do Brasil x emoji "
    assert T.replace_emoji("plain é text") == "plain é text" and T.emoji_class("🐈") == "animal"


def test_only_known_label_columns(spark):
    d = spark.createDataFrame([(1, "x")], "id long, gold string")
    assert files.label_column(d, "id", "gold", ("gold",)).first().label == "x"
    with pytest.raises(ValueError):
        files.label_column(d, "id", "secret", ("gold",))


def test_refresh_stops_at_the_budget(spark):
    v = spark.range(200).select((F.col("id") % 2).alias("t"), F.col("id").cast("string").alias("v"), F.expr("timestamp'2020-01-01' + make_dt_interval(0, id)").alias("at"))
    got = L.refresh_calls(v, "t", "at", ["v"], F.expr("timestamp'2021-01-01'"), 1).groupBy("t").agg(F.count("*").alias("n"), F.max("call").alias("c")).collect()
    assert {(r.t, r.n, r.c) for r in got} == {(0, 50, 1), (1, 50, 1)}
