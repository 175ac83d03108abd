"""Learned verdicts: quality cutoffs against a brute-force choice, classifiers by held-out accuracy."""

import random
from math import exp, lgamma, log, log1p

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA
from tidemark.llm import qda, quality_rules, toxicity

COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def features(r):
    _, _, words, chars, symbols, dup, again, lines, upper = r
    part = lambda a, b: a / b if b else 0.0
    return {"symbols_per_word": part(symbols, words), "upper_share": part(upper, chars), "dup_line_share": part(dup, lines), "repeat_share": part(again, words), "word_length": part(chars, words), "word_shortness": part(chars, words)}


def tail(n, k, p):
    return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)) for j in range(k + 1))


def brute_cuts(rows, good):
    hypotheses, limit = sum(len(c) for _, c in quality_rules.RULES.values()), quality_rules.RISK / len(quality_rules.RULES)
    strata = {}
    for r in rows:
        if r[0] in good and not (r[2] < 10 or 100 * r[6] > 20 * r[2]):
            strata.setdefault(r[1], []).append((features(r), good[r[0]]))
    able = max(1, sum((1 - limit) ** sum(g for _, g in s) <= quality_rules.DELTA / hypotheses for s in strata.values()))
    cuts = {}
    for lang, own in strata.items():
        n = sum(g for _, g in own)
        for rule, (side, grid) in quality_rules.RULES.items():
            best = None
            for place, c in enumerate(grid):
                hit = [g for f, g in own if (f[rule] > c if side > 0 else f[rule] < c)]
                false, gain = sum(hit), len(hit) - sum(hit) - quality_rules.GOOD_WEIGHT * sum(hit)
                if gain > 0 and false < n * limit and tail(n, false, limit) <= quality_rules.DELTA / hypotheses / able and (best is None or gain > best[0]):
                    best = gain, c
            if best:
                cuts.setdefault(lang, {})[rule] = best[1]
    return cuts


def test_quality_verdicts(spark):
    rng = random.Random(7)
    rows, good = [], {}
    for i in range(24000):
        lang = rng.choice(["en", "en", "fr", None, "xx", "other", "rare"]) if i % 40 else f"l{i % 7}"
        bad = rng.random() < 0.3 and lang != "xx"
        words = rng.randint(5, 300)
        rows.append((i, lang, words, words * (rng.randint(9, 16) if bad and lang == "fr" else rng.randint(3, 7)), int(words * rng.random() * (2 if bad else 0.2)), rng.randint(0, 6) if bad else 0, rng.randint(0, words // 4), 10, rng.randint(0, words)))
        if i % 5 and not (lang == "rare" and i % 50):
            good[i] = int(not bad) if rng.random() < 0.99 else int(bad)
    measured = spark.createDataFrame(rows + rows[:20], COUNTS)
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    cuts = brute_cuts(rows, good)
    found = quality_rules.thresholds(measured, labels)
    assert {r["_stratum"]: r["_cut"] for r in found.collect()} == cuts
    assert {"en", "fr", None, "other"} <= set(cuts) and not {"xx", "rare", "l1"} & set(cuts)  # only good documents, or few labels: no rule
    got = {r.doc_id: r.kept for r in quality_rules.judge(measured, found).collect()}
    for r in rows:
        f, own = features(r), cuts.get(r[1], {})
        base = r[2] < 10 or 100 * r[6] > 20 * r[2]
        hit = any(f[rule] > c if quality_rules.RULES[rule][0] > 0 else f[rule] < c for rule, c in own.items())
        assert got[r[0]] == (not base and not hit)
    monkey = quality_rules.BROADCAST
    try:
        quality_rules.BROADCAST = 0
        assert {r.doc_id: r.kept for r in quality_rules.judge(measured, found).collect()} == got
    finally:
        quality_rules.BROADCAST = monkey


def test_repeated_ids_learn_from_one_text(spark):
    rows = [(i % 40, f"{'good clean words here ' * 6} {i}", "en", "s", 0, "", "", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    some = [toxicity.sample(spark.createDataFrame(r, SCHEMA).repartition(p), labels, "toxic", F.lit(True)).collect() for r, p in ((rows, 1), (rows[::-1], 5))]
    assert sorted(some[0]) == sorted(some[1]) and len(some[0]) == 40


def auc(rows):
    rows = sorted(rows)
    ones = sum(y for _, y in rows)
    below = rank = 0
    for _, y in rows:
        rank += below * y
        below += 1 - y
    return rank / (ones * (len(rows) - ones))


@pytest.mark.parametrize("operator, label, least", [(qda, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, operator, label, least):
    """Labelled rows that the fit must not see, on the driver's documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(4)
    scored = operator.assess(known, labels).where("held_out").join(labels, "doc_id").select("score", F.col(label).alias("y"), "predicted").collect()
    area, right = auc([(r.score, r.y) for r in scored]), sum(r.predicted == r.y for r in scored) / len(scored)
    print(label, len(scored), area, right)
    assert len(scored) > 500 and area >= least and right >= 0.9
