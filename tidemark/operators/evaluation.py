"""Agreement and classification metrics from counts; ratios are columns, tables are combined before any shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .aggregates import fraction


def vote_counts(ratings: DataFrame, item: str, label: str, classes: tuple[str, ...]) -> DataFrame:
    return ratings.groupBy(item).agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes], F.count("*").alias("raters"))


def fleiss(votes: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Fleiss' kappa over items with equally many raters; null where chance agreement is complete."""
    n = F.col("raters")
    agree = sum((F.col(c) * (F.col(c) - 1) for c in classes), F.lit(0)) / (n * (n - 1))
    sums = votes.agg(F.avg(agree.cast("double")).alias("p"), *[F.sum(c).alias(c) for c in classes], F.sum("raters").alias("all"))
    chance = sum((F.pow(F.col(c) / F.col("all"), 2) for c in classes), F.lit(0.0))
    return sums.select(F.col("p").alias("observed"), chance.alias("expected"), F.try_divide(F.col("p") - chance, 1 - chance).alias("kappa"))


def fleiss_by_class(votes: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One class against the rest; classes that nobody or everybody chose are left out."""
    n = F.col("raters")
    long = votes.select("raters", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes])).alias("x")).select("raters", "x.*")
    sums = long.groupBy("class").agg(F.sum(F.col("n") * (n - F.col("n"))).alias("split"), F.sum("n").alias("hits"), F.sum(n).alias("all"), F.count("*").alias("items"), F.max(n).alias("m"))
    p = F.col("hits") / F.col("all")
    return sums.where((F.col("hits") > 0) & (F.col("hits") < F.col("all"))).select(
        "class", (1 - F.col("split") / (F.col("items") * F.col("m") * (F.col("m") - 1) * p * (1 - p))).alias("kappa")
    )


def cohen(pairs: DataFrame, a: str, b: str, classes: tuple[str, ...], *keys: str) -> DataFrame:
    """Cohen's kappa of two labels, per keys; null where chance agreement is complete."""
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"),
        *[F.count_if(F.col(a) == c).alias(f"a_{c}") for c in classes], *[F.count_if(F.col(b) == c).alias(f"b_{c}") for c in classes],
    )
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, sum((F.col(f"a_{c}") * F.col(f"b_{c}") for c in classes), F.lit(0)) / (n * n)
    return sums.select(*keys, "n", po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def prf(pairs: DataFrame, gold: str, predicted: str, classes: tuple[str, ...], *keys: str) -> DataFrame:
    """Precision, recall and F1 of every class, also of those that don't occur; 0 where undefined."""
    hit = [F.struct(F.lit(c).alias("class"), F.count_if((F.col(gold) == c) & (F.col(predicted) == c)).alias("tp"), F.count_if(F.col(predicted) == c).alias("pp"), F.count_if(F.col(gold) == c).alias("support")) for c in classes]
    rows = pairs.groupBy(*keys).agg(F.array(*hit).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.*")
    p, r = fraction("tp", "pp"), fraction("tp", "support")
    return rows.select(*keys, "class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def macro(rows: DataFrame, *keys: str) -> DataFrame:
    """Means over all classes; the denominator is fixed by the class set."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias("n"))


def drawn_weight(unit: str, seed: int) -> Column:
    """How often the unit is in resample b: Poisson(1) from a hash of both."""
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("b"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, tail, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(8):
        tail += term
        weight = weight + F.when(u > tail, 1).otherwise(0)
        term /= k + 1
    return weight


def weighted_macro_f1(rows: DataFrame, gold: str, predicted: str, weight: Column, classes: tuple[str, ...], *keys: str) -> DataFrame:
    """keys and macro F1 over all classes (the denominator is fixed) of weighted rows; classes that don't occur count 0."""
    w = lambda when: F.sum(F.when(when, weight).otherwise(0.0))
    per = [F.struct(w((F.col(gold) == c) & (F.col(predicted) == c)).alias("tp"), (w(F.col(predicted) == c) + w(F.col(gold) == c)).alias("both")) for c in classes]
    f1 = F.aggregate("x", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_divide(2.0 * t["tp"], t["both"].cast("double")), F.lit(0.0))) / len(classes)
    return rows.groupBy(*keys).agg(F.array(*per).alias("x")).select(*keys, f1.alias("macro_f1"))


def resampled(cells: DataFrame, resamples: int, seed: int, *strata: str) -> DataFrame:
    """Draws of whole samples from counts of equal rows: b (0 is the data itself) and drawn, how often each cell comes in draw b.

    Where the unit drawn is the row, equal rows differ in nothing, so the counts of a draw are multinomial over the cells (within
    each of the strata columns, if any): the work depends on the cells, not on the rows. cells: n and key columns, a few rows by
    their nature (tuples of classes and strata), which every task gets whole."""
    keys = [c for c in cells.columns if c != "n"]
    one = cells.agg(F.sort_array(F.collect_list(F.struct(*keys, F.col("n").cast("long").alias("n")))).alias("cells"))
    schema = ", ".join(f"`{c}` {t}" for c, t in cells.dtypes if c != "n")

    def draw(batches):
        for pdf in batches:
            for b, every in zip(pdf["b"], pdf["cells"], strict=True):
                frame = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else r for r in every])
                n = frame["n"].to_numpy()
                drawn = n.copy()
                if b:
                    rng = np.random.default_rng([seed, int(b)])
                    groups = frame.groupby(list(strata), dropna=False, sort=True).indices.values() if strata else [np.arange(len(n))]
                    for at in groups:
                        drawn[at] = rng.multinomial(n[at].sum(), n[at] / n[at].sum())
                yield frame.drop(columns="n").assign(b=b, drawn=drawn)[["b", *keys, "drawn"]]

    draws = cells.sparkSession.range(resamples + 1).withColumnRenamed("id", "b").crossJoin(F.broadcast(one))  # one row
    return draws.mapInPandas(draw, f"b long, {schema}, drawn long")


def bootstrap_paired(pairs: DataFrame, gold: str, a: str, b: str, classes: tuple[str, ...], resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Macro F1 of a less that of b, and its percentile interval with the same draws for both. One row."""
    cells = pairs.groupBy(F.col(gold).alias("gold"), F.col(a).alias("first"), F.col(b).alias("second")).agg(F.count("*").alias("n"))
    drawn = resampled(cells, resamples, seed)
    one, two = (weighted_macro_f1(drawn, "gold", c, F.col("drawn"), classes, "b").withColumnRenamed("macro_f1", c) for c in ("first", "second"))
    delta = one.join(two, "b").select("b", (F.col("first") - F.col("second")).alias("d"))
    of_draws = F.when(F.col("b") > 0, F.col("d"))
    return delta.agg(F.max(F.when(F.col("b") == 0, F.col("d"))).alias("delta"), F.percentile(of_draws, 0.025).alias("low"), F.percentile(of_draws, 0.975).alias("high"), F.count(of_draws).alias("resamples"))


def bootstrap_strata(pairs: DataFrame, gold: str, predicted: str, classes: tuple[str, ...], stratum: str, population: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Macro F1 for a population from a sample stratified otherwise: every row weighs N_s / n_s (population: stratum, N), and samples of the
    same size are redrawn within each stratum. One row."""
    cells = pairs.groupBy(F.col(stratum).alias("stratum"), F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("stratum").agg(F.sum("n").alias("_n")).join(population.select(F.col(stratum).alias("stratum"), "N"), "stratum")
    rows = resampled(cells, resamples, seed, "stratum").join(F.broadcast(sizes), "stratum")  # a row a stratum
    scores = weighted_macro_f1(rows, "gold", "predicted", F.col("drawn") * F.col("N") / F.col("_n"), classes, "b")
    of_draws = F.when(F.col("b") > 0, F.col("macro_f1"))
    return scores.agg(F.max(F.when(F.col("b") == 0, F.col("macro_f1"))).alias("macro_f1"), F.percentile(of_draws, 0.025).alias("low"), F.percentile(of_draws, 0.975).alias("high"), F.count(of_draws).alias("resamples"))


def bootstrap_macro_f1(pairs: DataFrame, gold: str, predicted: str, classes: tuple[str, ...], unit: str | None = None, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile intervals of each class's F1 and of macro F1 over the classes present, resampling rows, or whole clusters if unit names one.

    A class without support in a resample is left out there, so `resamples` counts the draws that an interval rests on.

    Rows are drawn as counts of confusion cells. A cluster's weight in a resample is Poisson(1) from a hash of (unit, resample), so no
    task needs all rows and the draws don't depend on the partitioning; clusters are first summed to their confusion cells."""
    if unit is None:
        cells = pairs.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
        drawn = resampled(cells, resamples, seed).where("b > 0").withColumnRenamed("drawn", "w")
        gold, predicted = "gold", "predicted"
    else:
        cells = pairs.groupBy(unit, gold, predicted).agg(F.count("*").alias("c"))
        drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).select("b", gold, predicted, (F.col("c") * drawn_weight(unit, seed)).alias("w")).where("w > 0")
    parts = [F.struct(F.lit(c).alias("class"), F.sum(F.when((F.col(gold) == c) & (F.col(predicted) == c), F.col("w")).otherwise(0)).alias("tp"), F.sum(F.when(F.col(predicted) == c, F.col("w")).otherwise(0)).alias("pp"), F.sum(F.when(F.col(gold) == c, F.col("w")).otherwise(0)).alias("s")) for c in classes]
    per = drawn.groupBy("b").agg(F.array(*parts).alias("x"))
    f1 = lambda t: F.coalesce(F.try_divide(2.0 * t["tp"], (t["pp"] + t["s"]).cast("double")), F.lit(0.0))
    each = F.transform(F.filter("x", lambda t: t["s"] > 0), lambda t: F.struct(t["class"].alias("class"), f1(t).alias("f1")))
    mean = F.try_divide(F.aggregate("e", F.lit(0.0), lambda a, v: a + v["f1"]), F.size("e").cast("double"))
    scores = per.select(each.alias("e")).where("size(e) > 0").select(F.explode(F.concat("e", F.array(F.struct(F.lit("macro").alias("class"), mean.alias("f1"))))).alias("x")).select("x.*")
    return scores.groupBy("class").agg(F.count("*").alias("resamples"), F.percentile("f1", 0.025).alias("low"), F.percentile("f1", 0.5).alias("middle"), F.percentile("f1", 0.975).alias("high"))


def human_ceiling(ratings: DataFrame, item: str, rater: str, label: str, model: DataFrame) -> DataFrame:
    """Each rater and the model against the consensus of the other two raters, where these agree."""
    a, b = ratings.alias("a"), ratings.alias("b")
    agreed = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{rater}") < F.col(f"b.{rater}")) & (F.col(f"a.{label}") == F.col(f"b.{label}")))
    consensus = agreed.select(F.col(f"a.{item}").alias("_i"), F.col(f"a.{rater}").alias("_r1"), F.col(f"b.{rater}").alias("_r2"), F.col(f"a.{label}").alias("gold"))
    third = ratings.join(consensus, (F.col(item) == F.col("_i")) & ~F.col(rater).isin(F.col("_r1"), F.col("_r2"))).select(F.col(rater).cast("string").alias("judged"), item, "gold", F.col(label).alias("predicted"))
    of_model = third.select(item, "gold").distinct().join(model, item).select(F.lit("model").alias("judged"), item, "gold", "predicted")
    return third.union(of_model)


def index_percentile(counts: DataFrame, value: str, n: str, share: float, *keys: str) -> DataFrame:
    """keys and the value at place min(int(share * N), N - 1) of the ascending values, from counts of each distinct value: a group is as
    large as its distinct values, however many rows it has."""
    order = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(n).over(W.partitionBy(*keys))
    at = F.least(F.floor(F.lit(share) * total), total - 1)
    return counts.select(*keys, value, F.sum(n).over(order).alias("_upto"), at.alias("_at")).where(F.col("_upto") > F.col("_at")).groupBy(*keys).agg(F.min(value).alias("at_share"))


BINS = 4096


def quantiles(rows: DataFrame, value: Column, shares: dict[str, float], *keys: str, bins: int = BINS) -> DataFrame:
    """keys and exact quantiles (interpolated between the two values around the place share * (n - 1)); rows without value don't count.

    Values are first counted. Then each place is sought by rounds of histograms between the least and the largest value that it
    can still have: the bin that holds it gives the next bounds, until these are one value. A task holds at most `bins` counts of
    a place, however many values a group has. Keys are compared null-safe."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    counts = rows.select(*named, value.cast("double").alias("_v")).where("_v is not null").groupBy(*ks, "_v").agg(F.count("*").alias("_n"))
    whole = counts.groupBy(*ks).agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    sides = F.array(*[F.struct(F.lit(s).alias("share"), f((F.col("n") - 1) * F.lit(s)).cast("long").alias("at")) for s in sorted(set(shares.values())) for f in (F.floor, F.ceil)])
    sought = whole.select("*", F.explode(F.array_distinct(F.transform(sides, lambda x: x["at"]))).alias("at")).select(*ks, "at", "lo", "hi", F.lit(0).cast("long").alias("before"))
    met = F.lit(True)
    for k in ks:
        met = met & F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    found = None
    while True:
        narrow = (F.col("hi") > F.col("lo")).alias("open")
        sought = sought.select("*", narrow)
        done = sought.where("not open").select(*ks, "at", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        left = sought.where("open").drop("open")
        if not left.take(1):
            break
        pairs = counts.alias("c").join(left.alias("s"), met & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*[f"s.{k}" for k in ks], "at", "before", "lo", "hi", "_v", "_n")
        # halves, so that bounds near the largest doubles don't overflow
        bin_ = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1)).alias("bin")
        per = pairs.groupBy(*ks, "at", "before", bin_).agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(*ks, "at").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
        hit = per.withColumn("_upto", upto).where((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("n")))
        sought = cut(hit.select(*ks, "at", "lo", "hi", (F.col("_upto") - F.col("n")).alias("before")))
    whole = whole.select(*ks, "n")
    got = found.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))  # two places a share
    match = F.lit(True)
    for k in ks:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = whole.alias("a").join(got.alias("b"), match).select(*[F.col(f"a.{k}") for k in ks], "n", "m")

    def at(share: float) -> Column:
        place = (F.col("n") - 1) * F.lit(share)
        low, high = F.element_at("m", F.floor(place).cast("long")), F.element_at("m", F.ceil(place).cast("long"))
        return low + (high - low) * (place - F.floor(place))

    return both.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], *[at(s).alias(name) for name, s in shares.items()])


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that the session's checkpoints go to."""
    from ..sources.store import shared_folder

    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
