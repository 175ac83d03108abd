"""Search by cells and trees: pruning happens, the relaxed factor keeps its recall, scales and ties are exact, and SQL agrees."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import registry, vptree


def clustered(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, dim))[rng.integers(0, 40, n)] * 2 + rng.normal(size=(n, dim))


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")


def brute(x, q, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit[q], 12)
    s[q] = -9
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_exact_and_relaxed_search_over_cells(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)  # cells are dealt over several shards
    x = clustered(3000, 8)
    df = frame(spark, x).repartition(5)
    want = {q: brute(x, q) for q in range(0, 3000, 50)}
    assert answers(vptree.nearest(df, F.col("vec_id") % 50 == 0)) == want
    loose = answers(vptree.nearest(df, F.col("vec_id") % 50 == 0, factor=1.3))
    assert np.mean([len(set(loose[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_trees_prune(spark):
    x = clustered(4000, 6)
    counts = {}
    for factor in (1.0, 1.5):
        tree = vptree.VPTree(x)
        tree.search(x[:50], 6, factor)
        counts[factor] = tree.compared / (50 * 4000)
    assert counts[1.5] < counts[1.0] < 0.7


def test_scale_and_ties(spark):
    x = clustered(600, 5)
    x[::3] *= 1e200
    x[1::3] *= 1e-200
    x[100:140] = np.outer(np.exp2(np.arange(40) - 20), x[100])  # more collinear vectors than neighbours asked for
    x[500] = x[100] * 4
    got = answers(vptree.nearest(frame(spark, x), F.col("vec_id").isin(100, 110, 500, 7)))
    small = vptree.scaled(x)
    assert got == {q: brute(small, q) for q in (100, 110, 500, 7)}
    assert got[500] == [100, 101, 102, 103, 104]


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    want = con.sql(registry.ORACLES["op4_vantage_point_search"]).fetchall()
    got = registry.op4_vantage_point_search(spark, "/root/testdata/sf0.01").select("query_id", "rank", "vec_id", F.round("score", 12)).collect()
    assert sorted(map(tuple, got)) == sorted((q, r, v, round(s, 12)) for q, r, v, s in want) and len(want) == 50
