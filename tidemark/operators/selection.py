"""Choice among configurations, folds and seeds by metrics of their predictions; predictions come as rows, from any classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from . import evaluation as E, sampling as S

#: Gain from which a method is adopted, drop from which a loss is relevant.
ADOPT, RELEVANT = 0.010, 0.03


def fold_scores(predictions: DataFrame, gold: str, predicted: str, classes: tuple[str, ...], *keys: str) -> DataFrame:
    """keys and macro F1, the denominator fixed by the class set."""
    return E.weighted_macro_f1(predictions, gold, predicted, F.lit(1), classes, *keys)


def best(scores: DataFrame, config: str, score: str = "macro_f1") -> DataFrame:
    """The configuration with the best score, the simplest of equals. One row."""
    return scores.agg(F.max_by(config, F.struct(F.round(score, 9), -F.col(config))).alias(config), F.max(F.round(score, 9)).alias("best"))


def seed_summary(scores: DataFrame, seed: str, score: str = "macro_f1") -> DataFrame:
    """Mean, spread and the seed to publish: that of the median score. A row a seed comes in."""
    order = F.sort_array(F.collect_list(F.struct(F.round(score, 9).alias("f"), F.col(seed).alias("s"))))
    t = scores.agg(F.count("*").alias("seeds"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("deviation"), order.alias("o"))
    return t.select("seeds", "mean", "deviation", F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int"))["s"].alias("published"))


def round_partition(rows: DataFrame, stratum: str, key: str, test: Column, leaked: DataFrame | None = None, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Side of every row in a round: test rows as marked, the others split by seed; rows that leak into the test are left out if told so."""
    rest = rows.where(~test)
    if leaked is not None:
        rest = rest.join(leaked.select(key), key, "left_anti")
    sides = S.split(rest, stratum, key, share, seed).select(key, stratum, "side")
    return sides.union(rows.where(test).select(key, stratum, F.lit("test")))


@dataclass(frozen=True)
class Classifier:
    """A classifier as batches of texts to (label, justification); version is that of the text it expects."""

    name: str
    version: int
    classify: Callable[[pd.Series], pd.DataFrame]


def classify(texts: DataFrame, text: str, candidates: list[Classifier | None], text_version: int) -> DataFrame:
    """texts with label, justification and the classifier's name. The first candidate that is there and expects this version of the text is
    taken for all rows, at start: rows never mix classifiers."""
    usable = [c for c in candidates if c is not None and c.version == text_version]
    if not usable:
        raise ValueError("no classifier for this version of the text")
    chosen = usable[0]

    @pandas_udf("label string, justification string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield chosen.classify(x)

    return texts.withColumn("_c", run(F.col(text))).select("*", "_c.label", "_c.justification", F.lit(chosen.name).alias("classifier")).drop("_c")


def argmax_softmax(logits: Column, labels: tuple[str, ...]) -> Column:
    """(label, confidence) of an array of logits: the winner, the first of equals, with its share. Batches by Arrow, stable for large logits."""

    @pandas_udf("label string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            z = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(labels)))
            e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
            best = z.argmax(axis=1)
            yield pd.DataFrame({"label": np.array(labels, dtype=object)[best], "confidence": e[np.arange(len(e)), best] / e.sum(axis=1)})

    return run(logits)


def stable_name(name: Column) -> Column:
    """Model names that stay what they are: no preview, no experiment, no alias for the latest."""
    return ~F.lower(name).rlike(r"preview|exp(?:erimental)?\b|latest")
