"""Filter interactions against applying the filters one after the other."""

import re
from itertools import permutations

import numpy as np
import pytest

from tidemark.llm import audit, registry
from tests.llm.test_operators import corpus

SCHEMA = "doc_id long, text string, source string, part string, mask string, digest int, id int, root int"


def brute(rows, labels):
    said = {}
    for i, q, t in labels:
        was = said.get(i, (0, 0))
        said[i] = (max(was[0], int(q == 1)), max(was[1], int(t == 1)))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failed.append((s or "", {k for k, v in f.items() if v}, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = {}, {}
    for part in {x[0] for x in failed}:
        own = [x[1:] for x in failed if x[0] == part]
        for o in permutations("ABCDE"):
            left = own
            for s, k in enumerate(o, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                redundant = sum(k in x[0] for x in own) - len(gone)
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                out[part, "".join(o), s] = (len(left), len(gone), redundant, sum(x[0] == {k} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_incidence():
    m = audit.incidence()
    assert all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    assert (m["removed"].sum(axis=1) == np.where(np.arange(32) > 0, 120, 0)).all()  # a failing document goes once in each order
    assert (m["removed"] + m["redundant"]).sum() == 16 * 600


@pytest.mark.parametrize("repeated", [False, True])
def test_against_brute_force(spark, repeated):
    texts = corpus()
    rows = [(3 * i, t, [None, "s", "", "web"][i % 4]) for i, t in enumerate(texts)]
    rows += [(1, texts[2], "late"), (500, texts[60], "web"), (None, texts[60], "web"), (None, "none alike", "web"), (None, "none alike", None), (7, "SHOUT " * 60, "web"), (8, "a b# " * 60, None)]
    if repeated:
        rows += rows[:40:3] + [(3, texts[1], "another part"), (3, "another text", "web")] * 2
    labels = [(3 * i, i % 2, int(i % 5 == 0)) for i in range(len(texts))] + [(3, None, 1), (None, 1, 1), (10**9, 1, 1), (6, 0, 0)]
    docs = spark.createDataFrame([(i, t, s, "clash", "clash", 1, 2, 3) for i, t, s in rows], SCHEMA)
    got = {(r["part"], r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute(rows, labels)
    assert audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_query_against_its_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    rel = con.sql(registry.ORACLES["op13_filter_audit"])
    df = registry.QUERIES["op13_filter_audit"](spark, data)
    assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall())
