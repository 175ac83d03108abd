"""Scores of both classifiers recomputed the long way: Gaussian densities by numpy, n-grams by a plain loop over the trained table."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import qda, toxicity

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    out = []
    for i in range(400):
        said = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        said += ["#$%"] * rng.randint(0, 8) if i % 3 == 0 else []
        said += ["idiot", "IDIOTS"] if i % 4 == 1 else []
        rng.shuffle(said)
        out.append((i, " ".join(said).replace(" ", "\n", i % 5), int(i % 3 != 0), int(i % 4 == 1)))
    return [*out, (400, None, 1, 0), (401, "", 0, 0), (402, " \n", None, None), (403, "漢字 😀 9", None, None)]


def test_quality_by_densities(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qda.assess(docs, labels).collect()}
    x = np.array([qda.statistics(t.encode() if t else None) for _, t, *_ in rows])
    use = np.array([q is not None and zlib.crc32(str(i).encode()) % 5 != 0 for i, _, q, _ in rows])
    y = np.array([q or 0 for _, _, q, _ in rows])
    z = (x - x[use].mean(axis=0)) / (x[use].std(axis=0) + 1e-6)
    logs = []
    for c in (0, 1):
        own = z[use & (y == c)]
        cov = np.cov(own.T)
        p = len(cov)
        cov = (1 - qda.SHRINK) * cov + qda.SHRINK * max(np.trace(cov) / p, 1e-3) * np.eye(p)
        d = z - own.mean(axis=0)
        logs.append(np.log(len(own)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    for k, (i, *_) in enumerate(rows):
        assert got[i].score == pytest.approx(want[k], abs=1e-7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity_by_a_plain_loop(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None], "doc_id long, quality int, toxic int")
    value, bias = toxicity.fit(docs, labels, toxicity.crc_fold("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, (value, bias)).collect()}
    for i, text, *_ in rows:
        parts = []
        for word in toxicity.WORD.findall((text or "").lower()):
            w = f"<{word}>".encode()
            grams = [w[k : k + n] for n in toxicity.GRAMS for k in range(len(w) - n + 1)] + [w]
            parts.append(np.mean([float(value[zlib.crc32(g) % toxicity.BUCKETS]) for g in grams]))
        odds = bias + (np.mean(parts) if parts else 0.0)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -60, 60))), abs=1e-9)
    # what is trained tells the classes apart on rows that the fit didn't see
    held = [(got[i], t) for i, _, _, t in rows if t is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert min(s for s, t in held if t) > max(s for s, t in held if not t) - 0.2
    assert docs.where(F.col("doc_id") == 400).count() == 1 and got[400] == got[401] == got[402]
