"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards a multiple of the identity; the score is the posterior of class 1
from the difference of the two log densities, with Mahalanobis terms from Cholesky factors that are
computed once and broadcast with the model (a few hundred numbers).

The fit uses at most SAMPLE labelled rows of each class, those with the smallest hash of their id; only their statistics
reach the driver. Scoring is a narrow map over all documents.

Edge cases: null text counts as empty and has the statistics of no words; repeated rows score alike; a class
without labels gives a constant score (0.5); rows of labels without a document, or a null label, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .toxicity import crc_fold, sample

SAMPLE = 10_000  # labelled rows of each class at most
SHRINK = 0.05
THRESHOLD = 0.3
SYMBOLS, UPPER, DIGITS, MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"
STATISTICS = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "shouts", "varied", "pairs", "dup_lines", "log_line", "top_word")


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text, transformed to be nearer to normal."""
    b = text or b""
    words = b.split()
    n, size = len(words), max(1, len(b))
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / size
    lines = [x for x in b.split(b"\n") if x.strip()]
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    inner = sum(map(len, words))
    return [
        float(np.log1p(n)),
        float(np.log(inner / n)),
        share(SYMBOLS) ** 0.5,
        share(UPPER) ** 0.5,
        share(DIGITS) ** 0.5,
        share(MARKS) ** 0.5,
        (b.count(b"!") / size) ** 0.5,
        float(np.log(kinds) / np.log(n + 1)),
        (1 - pairs / max(1, n - 1)) ** 0.5 if n > 1 else 0.0,
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        float(np.log1p(n / len(lines))),
        (max(len(w) for w in words) / inner) ** 0.5,
    ]


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = SHRINK):
        self.flat = min((y == 0).sum(), (y == 1).sum()) < 2
        if self.flat:
            return
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.middle) / self.scale
        self.parts = []
        for c in (0, 1):
            own = z[y == c]
            cov = np.cov(own.T)
            p = len(cov)
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / p, 1e-3) * np.eye(p)
            root = np.linalg.cholesky(cov)
            self.parts.append((own.mean(axis=0), np.linalg.inv(root).T, -np.log(np.diag(root)).sum() + np.log(len(own) / len(z))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if self.flat:
            return np.full(len(x), 0.5)
        z = (x - self.middle) / self.scale
        bad, good = (c - 0.5 * (((z - m) @ w) ** 2).sum(axis=1) for m, w, c in self.parts)
        # rounded, as sums may differ in the last digit with the size of the batch that a row is in
        return np.round(1 / (1 + np.exp(np.clip(bad - good, -60, 60))), 12)


def _each(docs: DataFrame, keep: list[str], make, kind) -> DataFrame:
    """keep columns and make(batch of statistics) for each row."""
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(len(keep)).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], make(x)], [*keep, "value"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, StructType([*fields, StructField("value", kind)]))


def fit(docs: DataFrame, labels: DataFrame, usable) -> Discriminant:
    some = sample(docs, labels, "quality", usable, SAMPLE)
    rows = _each(some, ["doc_id", "_class"], lambda x: pa.array(x.tolist(), pa.list_(pa.float64())), ArrayType(DoubleType())).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Discriminant(np.array([r["value"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["_class"] for r in rows]))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; rows whose crc32 mod 5 is 0 are never learned from."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, crc_fold("doc_id", 5) != 0))
    scored = _each(docs.select("doc_id", "text"), ["doc_id"], lambda x: pa.array(model.value.score(x), pa.float64()), DoubleType())
    return scored.select(
        "doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= THRESHOLD).cast("int").alias("predicted")
    )
