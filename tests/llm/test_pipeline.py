"""The pipeline's stages on a small input, each against brute force over the stage's own input."""

import numpy as np
import zlib

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_print, brute_words, corpus


def test_stages(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", "s", 0, "clash", "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[3:4], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("diot" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and all(r["n_words"] == "clash" for r in got)
        after = {r["doc_id"]: r["text"] for r in got} if name != "best_fit_packing" else {}
        if name == "quality_rules":
            assert all(len((t or "").split()) >= 10 for t in after.values()) and after.items() <= before.items()
        if name == "simhash_near_dedup":
            prints = {i: brute_print(t) for i, t in before.items()}
            root = {i: i for i in before}
            for _ in before:
                for i in before:
                    for j in before:
                        if (prints[i] ^ prints[j]).bit_count() <= 3:
                            root[i] = root[j] = min(root[i], root[j])
            assert set(after) == set(root.values()) and len(got) == len(after)
        if name == "substring_dedup":
            order = sorted(before)
            want = brute_words([before[i] for i in order])
            import hashlib

            for k, i in enumerate(order):
                n, gone, sha = want[k]
                kept = after[i] if gone else " ".join((after[i] or "").encode().split().__len__() and [w.decode() for w in after[i].encode().split()] or [])
                assert hashlib.sha256(kept.encode()).hexdigest() == sha
    assert docs.count() and set(docs.columns) >= {"doc_id", "sequence_id", "offset"}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_any_further_column(spark, tmp_path):
    """Columns named as those that stages use inside pass through."""
    names = ["_id", "_id_", "_own", "_row", "_rest", "_text", "_md5", "_key", "_runs", "_copy", "_stratum", "_cut", "kept", "score", "fingerprint", "root", "island", "bin"]
    rows = [(i, (t or "x") + " and ten more words so that the base rule is met here", "en", *[f"{i}{n}" for n in names]) for i, t in enumerate(corpus()[:25])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", *names] and got, name
        assert all(r[n] == f"{r.doc_id}{n}" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(got)


def kept_rows(spark, rows, name="simhash_near_dedup"):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((tuple(r) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()), key=repr)


def test_near_dedup_of_repeated_ids(spark):
    """Each text of a doc_id goes only with its own component, whatever the order of rows."""
    a, b, c = ("en", "s", 0), ("fr", "s", 0), ("en", "t", 1)
    one, two, three = "the first text of some ten words that stays alone here", "another one which has nothing in common with that before it", "a third that comes without any identifier but must stay as well"
    rows = [(3, one, *a), (5, one, *a), (5, two, *a), (5, two, *b), (5, two, *b), (7, two.upper(), *c), (None, three, *a), (None, three, *a), (None, one, *a), (8, three, *a), (8, three, *a)]
    want = None
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        got = kept_rows(spark, order)
        assert sorted((i, t) for i, t, *_ in got if i is not None) == [(3, one), (5, two), (8, three)]
        assert sum(i is None for i, *_ in got) == 3  # rows without doc_id pass
        assert want in (None, got)
        want = got


def test_quality_and_toxicity_decisions(spark, tmp_path):
    """Both stages keep what the operators' verdicts on their input say."""
    import random

    from tidemark.llm import quality_rules, toxicity
    from tidemark.llm.io import table

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad, foul = i % 3 == 0, i % 4 == 1
        said = [rng.choice(words) for _ in range(40)] + ["#$%" if bad else "fine"] * 6 + (["idiot", "idiotic", "1diot"] if foul else [])
        rng.shuffle(said)
        rows.append((i, " ".join(said) if i % 50 else ["few words", None, ""][i % 3], ["en", "fr", None][i % 3 if not bad else 0], "s", 0))
        labels.append((i, int(not bad), int(foul)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    said = table(spark, str(tmp_path), "labels")
    stages = dict(corpus_pipeline.STAGES)
    verdict = {r.doc_id for r in quality_rules.assess(docs, said).collect() if r.kept}
    got = stages["quality_rules"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == verdict and 0 < len(verdict) < 900
    assert verdict == {i for i, t, *_ in rows if i in verdict and len((t or "").split()) >= 10}
    predicted = {r.doc_id for r in toxicity.assess(docs, said).collect() if r.predicted == 0}
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert kept == predicted
    foul = {i for i, _, t in labels if t and rows[i][1] and len(rows[i][1]) > 20}
    assert len(foul & kept) < 0.1 * len(foul) and len(kept - foul) > 0.95 * (900 - len(foul))
