"""The dashboard against its SQL where runs end at the same time and orders have no comments."""

from __future__ import annotations

from datetime import datetime
from itertools import permutations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries

TABLES = "nation", "customer", "orders", "lineitem"


def write(folder, lines: list[int]) -> None:
    """Three runs of one tenant, last in 2001 at the same time; lines are the orders of the line items, in the file's order. Order 3 has none."""
    at = datetime(2001, 8, 1)
    tables = {
        "nation": {"n_nationkey": [0, 1, 2], "n_regionkey": [0, 2, 4]},
        "customer": {"c_custkey": [0, 1, 2, 3], "c_nationkey": [0, 1, 2, 0], "c_mktsegment": ["A", "A", "B", "unseen"]},
        "orders": {"o_orderkey": [0, 1, 2, 3], "o_custkey": [0, 1, 2, 3], "o_orderdate": [at] * 4, "o_totalprice": [1.0] * 4},
        "lineitem": {"l_orderkey": lines, "l_partkey": [0] * len(lines), "l_linenumber": list(range(len(lines))), "l_returnflag": ["A"] * len(lines)},
    }
    for name in TABLES:
        pq.write_table(pa.table(tables[name]), folder / f"{name}.parquet")


@pytest.mark.parametrize("lines", list(permutations([0, 1, 2])))
def test_ties_go_to_the_first_comment(spark, tmp_path, lines):
    write(tmp_path, list(lines) * 5000)  # more than orders, so that the line items are read last, as in whole tables
    db = duckdb.connect(config={"threads": 1})
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = db.execute(oracle_sql()["agg_dashboard"])
    names = [c[0] for c in want.description]
    got = queries()["agg_dashboard"](spark, str(tmp_path)).select(names).collect()
    assert [tuple(r) for r in got] == want.fetchall() == [(0, 3, 3, 2, 15000, [2001, 22001, 42001][lines[0]])]
