"""What the Python workers of a stage hold: one worker a task, and no free memory of Arrow after it."""

import re

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, corpus
from tidemark.llm import io, substring, suffix_dedup


def chained(df) -> int:
    """Arrow functions of a plan that are fed by another one within the same stage: a task then runs a worker for each."""
    above, found = [(-1, False)], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        indent, name = re.match(r"([ :+-]*)(?:\*\(\d+\) )?(\w*)", line).groups()
        while above[-1][0] >= len(indent):
            above.pop()
        own = "MapInArrow" in name
        found += own and above[-1][1]
        above.append((len(indent), own or above[-1][1] and "Exchange" not in name))
    return found


@pytest.mark.parametrize("of", [substring.remove, suffix_dedup.digests, lambda d: corpus_pipeline.near_dedup_stage(d.sparkSession, d, "")])
def test_a_task_runs_one_worker(spark, of):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "clash", "clash", 1) for i, t in enumerate(corpus()[:20])], SCHEMA)
    double = docs.select("doc_id", "text").mapInArrow(lambda batches: batches, "doc_id long, text string").mapInArrow(lambda batches: batches, "doc_id long, text string")
    assert chained(double) == 1
    assert chained(of(docs.select("doc_id", "text", "lang"))) == 0


def test_free_arrow_memory_goes_back_after_a_task(monkeypatch):
    called = []

    class Pool:
        def release_unused(self):
            called.append(1)

    monkeypatch.setattr(io.pa, "default_memory_pool", Pool)
    run = io.released(lambda batches: (b.slice(1) for b in batches))
    batch = pa.record_batch([pa.array([1, 2])], ["x"])
    assert [b.num_rows for b in run([batch, batch])] == [1, 1] and called == [1]
    early = run([batch, batch])
    next(early)
    early.close()
    assert called == [1, 1]
