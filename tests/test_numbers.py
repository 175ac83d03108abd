"""Places within strata and exact quantiles against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E, sampling as S


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, id long, x int").repartition(5)
    got = {r.id: (r.place, r["size"]) for r in S.numbered(df, ["s"], F.shiftright("id", 3), [F.col("id")]).collect()}
    for s in ("a", "b", None):
        ids = sorted(i for t, i, _ in rows if t == s)
        assert [got[i] for i in ids] == [(k, len(ids)) for k in range(1, len(ids) + 1)]
    two = S.numbered(df, ["s", "x"], F.lit(0), [F.col("id")]).groupBy("s", "x").agg(F.max("place").alias("m"), F.first("size").alias("n"), F.count("*").alias("c"))
    assert all(r.m == r.n == r.c for r in two.collect())


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    values = {"even": list(range(1000)), "one": [7.0], "ties": [1.0] * 50 + [2.0] * 3, "wide": [*(10.0 ** rng.integers(-300, 300, 200)), -1e308, 1e308, 0.0, -0.5], "normal": list(rng.normal(size=3000)), None: [3.0, 4.0]}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for bins in (4, 4096):
        got = {r.k: (r.p5, r.middle, r.most) for r in E.quantiles(df, F.col("v"), {"p5": 0.05, "middle": 0.5, "most": 1.0}, "k", bins=bins).collect()} if bins > 4 else {
            r.k: (r.p5, r.middle, r.most) for r in E.quantiles(df.where("k <> 'wide' or k is null"), F.col("v"), {"p5": 0.05, "middle": 0.5, "most": 1.0}, "k", bins=bins).collect()
        }
        assert set(got) == {k for k in values if bins > 4 or k != "wide"}
        for k, q in got.items():
            v = np.sort(np.array(values[k], float))
            for s, x in zip((0.05, 0.5, 1.0), q, strict=True):
                at = (len(v) - 1) * s
                low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
                assert np.isclose(x, low + (high - low) * (at - np.floor(at)), rtol=1e-12), (k, s)
