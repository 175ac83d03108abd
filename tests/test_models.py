"""The queries of fitted models on the smallest tables: whole, held out, and better than guessing."""

import pytest

from tidemark import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    return {r.doc_id: r.doc_id % 10 for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_every_held_out_row_is_predicted_once(spark, parts):
    got = registry.QUERIES["ml_tfidf_logreg"](spark, DATA).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(i for i, p in parts.items() if p >= 8 and i in known)
    assert sum(r.gold == r.predicted for r in got) > len(got) / 2


def test_folds_hold_out_all(spark):
    got = registry.QUERIES["ml_group_cv"](spark, DATA).collect()
    for scheme in ("random", "by_video"):
        of = [r for r in got if r.scheme == scheme]
        assert sum(r.n for r in of if r.fold is not None) == next(r.n for r in of if r.fold is None)


def test_one_configuration_is_chosen(spark):
    got = sorted(registry.QUERIES["ml_grid_search"](spark, DATA).collect(), key=lambda r: r.config)
    best = max(round(r.macro_f1, 9) for r in got)
    assert [r.config for r in got] == list(range(12)) and [r.config for r in got if r.chosen] == [min(r.config for r in got if round(r.macro_f1, 9) == best)]
