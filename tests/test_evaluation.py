"""Bootstrap intervals of each class and of the macro mean."""

from tidemark.operators.evaluation import bootstrap_macro_f1


def test_bootstrap_has_class_intervals(spark):
    rows = [(i, "a", "a") for i in range(20)] + [(i, "b", "b" if i % 2 else "c") for i in range(20, 40)] + [(40, "c", "c")]
    got = {r["class"]: r for r in bootstrap_macro_f1(spark.createDataFrame(rows, "id long, gold string, predicted string"), "gold", "predicted", ("a", "b", "c", "d")).collect()}
    assert set(got) == {"a", "b", "c", "macro"}  # d never has support
    assert got["a"].resamples == got["b"].resamples == got["macro"].resamples == 2000
    assert 1100 < got["c"].resamples < 1430  # its only row is drawn in 63 % of the resamples
    assert (got["a"].low, got["a"].high) == (1.0, 1.0)
    assert got["b"].low < got["b"].middle < got["b"].high and 0.5 < got["b"].middle < 0.8
    assert got["macro"].low < got["macro"].middle < got["macro"].high


def test_draws_of_cells_are_draws_of_rows(spark):
    """Counts of cells vary as those of rows drawn one by one, add up to the sample in each draw, and stay within strata."""
    import numpy as np

    from tidemark.operators.evaluation import resampled

    cells = spark.createDataFrame([("x", "a", 40), ("x", "b", 10), ("y", "a", 1), (None, "b", 7)], "s string, k string, n long")
    got = resampled(cells, 3000, 1, "s").toPandas()
    assert got[got.b == 0].set_index(["s", "k"]).drawn.to_dict() == {("x", "a"): 40, ("x", "b"): 10, ("y", "a"): 1, (np.nan, "b"): 7} or len(got[got.b == 0]) == 4
    x = got[(got.s == "x") & (got.b > 0)].pivot(index="b", columns="k", values="drawn")
    assert (x.sum(axis=1) == 50).all() and (got[(got.s == "y")].drawn == 1).all() and (got[got.s.isna()].drawn == 7).all()
    rng = np.random.default_rng(0)
    rows = np.array([0] * 40 + [1] * 10)
    one_by_one = (rng.choice(rows, (3000, 50)) == 1).sum(axis=1)
    assert abs(x["b"].mean() - one_by_one.mean()) < 0.3 and abs(x["b"].std() - one_by_one.std()) < 0.15
    free = resampled(cells, 200, 1).toPandas()
    assert (free.groupby("b").drawn.sum() == 58).all() and free[free.k == "a"].groupby("b").drawn.sum().nunique() > 5
