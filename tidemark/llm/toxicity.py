"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with word borders) and of itself, hashed into a
fixed table; a document is the mean of its words; the softmax is linear. Embeddings and softmax weights are learned
together by per-document Adagrad steps, so a misspelling unseen in training scores by the n-grams that it shares.
With two classes the score needs one number a table row (its vector along the weights' difference); that vector is
broadcast, 4 bytes times BUCKETS.

Training uses at most SAMPLE rows of each class, those with the smallest hash of their id; tasks count their words, and
only the distinct words of a text and their counts reach the driver. The table, the sample and the
model do not grow with the corpus. The first dimension starts as naive Bayes log-odds. Scoring is a narrow map over all documents.

Edge cases: null or wordless text scores by the bias alone; repeated rows score alike; no labels of a class
give a constant score (0.5); rows of labels without a document, or a null label, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import CHUNKS, WORDS, _Cache
from .io import released

BUCKETS, DIM = 1 << 18, 6
SAMPLE = 2000  # training rows of each class at most
EPOCHS, RATE = 6, 0.02
GRAMS = (3, 4, 5)  # lengths of n-grams, in UTF-8 bytes
SURE = 3.0  # standard errors by which a row's log-odds must differ from zero to be its start value
THRESHOLD = 0.7
WORD = regex.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Table rows of a word: its n-grams and itself."""
    w = f"<{word}>".encode()
    crc, mask, size = zlib.crc32, BUCKETS - 1, len(w) + 1
    rows = [crc(w[i : i + n]) & mask for n in GRAMS for i in range(size - n)]
    rows.append(crc(w) & mask)
    return rows


def crc_fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


class Bags:
    """Documents as table rows with weights that sum to one, end to end in two arrays."""

    STEP = 256  # documents whose parts are held singly

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray]]):
        rows, weights, sizes, some = [], [], [], []
        for part in (*parts, None):
            if part is not None:
                some.append(part)
                sizes.append(len(part[0]))
            if some and (part is None or len(some) == self.STEP):
                rows.append(np.concatenate([r for r, _ in some]))
                weights.append(np.concatenate([w for _, w in some]))
                some = []
        self.rows, self.weights, self.ends = np.concatenate(rows), np.concatenate(weights), np.cumsum(sizes)

    @staticmethod
    def cache() -> dict:
        return _Cache(lambda w: np.array(subwords(w), dtype=np.int32), 100_000)

    @staticmethod
    def one(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        return Bags.of(*Bags.counted(text), cache)

    @staticmethod
    def counted(text: str) -> tuple[list[str], np.ndarray]:
        """The distinct words of a text, in order, and their counts."""
        words = WORD.findall(text.lower())
        if not words:
            return [], np.zeros(0, np.int64)
        names, counts = np.unique(words, return_counts=True)
        return list(map(str, names)), counts

    @staticmethod
    def of(names: list[str], counts: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        if not names:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        rows, total = [cache[w] for w in names], int(counts.sum())
        weights = [np.full(len(r), c / total / len(r)) for r, c in zip(rows, counts)]
        flat, at = np.unique(np.concatenate(rows), return_inverse=True)
        return flat.astype(np.int32), np.bincount(at, np.concatenate(weights)).astype(np.float32)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[k - 1] if k else 0, self.ends[k])
        return self.rows[at], self.weights[at]


def train(texts: list[str], classes: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    cache = Bags.cache()
    return train_bags((Bags.one(t, cache) for t in texts), classes, seed)


def train_bags(parts: Iterable[tuple[np.ndarray, np.ndarray]], classes: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    """Score of each table row and bias, such that a document's log-odds are its weighted mean of rows plus the bias."""
    if len(set(classes)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    bags = Bags(parts)
    weight = {c: len(classes) / 2 / classes.count(c) for c in (0, 1)}
    # the first dimension starts at the rows' log-odds, less what chance may give; averages over long
    # texts are so small that from a random start the rows seen in one document would be learned first
    df = np.full((2, BUCKETS), 0.5)
    for k, c in enumerate(classes):
        df[c][bags[k][0]] += 1
    odds = np.log(df[1] / (classes.count(1) + 1)) - np.log(df[0] / (classes.count(0) + 1))
    table = rng.uniform(-0.01, 0.01, (BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * np.sqrt((1 / df).sum(axis=0)))
    softmax, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    softmax[:, 0] = -20, 20
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((2, DIM), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        step = 1 - epoch / EPOCHS
        for k in rng.permutation(len(classes)):
            rows, w = bags[k]
            vectors = table[rows]
            mean = w @ vectors
            z = softmax @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[k]] -= 1
            p *= weight[classes[k]]
            back = p @ softmax
            outer = np.outer(p, mean)
            seen_softmax += outer**2
            softmax -= 20 * step * outer / np.sqrt(seen_softmax)
            seen_bias += p**2
            bias -= step * p / np.sqrt(seen_bias)
            if len(rows):
                seen[rows] += w**2 * float(back @ back)
                table[rows] = vectors - (RATE * step * w / np.sqrt(seen[rows]))[:, None] * back
    return (table @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, size: int = SAMPLE) -> DataFrame:
    """Texts and classes of at most size labelled rows of each class, by smallest hash of the id; of a doc_id with several texts the one
    with the smallest digest."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).alias("_class"))
    some = [known.where(F.col("_class") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    ids = some[0].union(some[1]).select(F.col("doc_id").alias("_id"), "_class")  # 2 * size rows at most
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_class").groupBy("doc_id", "_class").agg(F.min_by("text", F.md5("text")).alias("text")).select("doc_id", "text", "_class")


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[np.ndarray, float]:
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                counted = [Bags.counted(t) for t in part.column(1).to_pylist()]
                packed = [pa.array([" ".join(w) for w, _ in counted], pa.string()), pa.array([n.astype(np.int32).tobytes() for _, n in counted], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *packed], ["doc_id", "class", "words", "counts"])

    some = sample(docs, labels, "toxic", usable).select(F.col("doc_id").cast("long"), "text", F.col("_class").cast("int"))
    rows = sorted(some.mapInArrow(released(run), "doc_id long, class int, words string, counts binary").collect())
    cache = Bags.cache()
    return train_bags((Bags.of(r["words"].split(), np.frombuffer(r["counts"], np.int32), cache) for r in rows), [r["class"] for r in rows])


def _scorer(model: tuple[np.ndarray, float]):
    """Function from a list of texts to their scores."""
    value, bias = model[0].tolist(), model[1]

    def of_word(word: str) -> float:
        rows = subwords(word)
        return sum(map(value.__getitem__, rows)) / len(rows)

    known = _Cache(of_word, WORDS)

    def of_chunk(chunk: str) -> tuple[float, int]:
        words = WORD.findall(chunk.lower())
        return sum(map(known.__getitem__, words)), len(words)

    cache = _Cache(of_chunk, CHUNKS)

    def scores(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            got = list(map(cache.__getitem__, (text or "").split()))
            n = sum([g[1] for g in got])
            out[k] = bias + (sum([g[0] for g in got]) / n if n else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scores = _scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(released(run), docs.schema)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; rows whose crc32 mod 3 is 1 are never learned from."""
    model = fit(docs, labels, crc_fold("doc_id", 3) != 1)
    return score(docs, model).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
