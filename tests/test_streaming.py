"""Streaming forms, fed from files."""

import random

from pyspark.sql import functions as F

from tidemark.operators.matching import limit_verdicts
from tidemark.streaming import stateful


def limited(rows, most, seconds):
    out, kept = {}, {}
    for k, t, i in sorted(rows):
        mine = [x for x in kept.get(k, []) if x > t - seconds]
        out[i] = len(mine) < most
        kept[k] = [*mine, t] if out[i] else mine
    return out


def test_rate_limit_across_batches_and_a_restart(spark, tmp_path):
    """Three micro-batches, the last one after a restart from the checkpoint: the verdicts are those of one pass over all events."""
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), float(rng.randrange(500)), i) for i in range(90))
    late = sorted(r[1] for r in rows)
    parts = [[r for r in rows if late[30 * k] <= r[1] < (late[30 * k + 30] if k < 2 else 1e9)] for k in range(3)]
    stateful.set_store(spark)
    schema = "key string, at double, job_id long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = stateful.rate_limited(stream, "key", "at", "job_id", 3, 60)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for k in (0, 1):
        spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    run()
    spark.createDataFrame(parts[2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    got = {r.event: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = limited(rows, 3, 60)
    assert got == want and 5 < sum(not x for x in want.values()) < 85
    batch = {r.event: r.allowed for r in limit_verdicts(spark.createDataFrame(rows, schema), "key", "at", "job_id", 3, 60).collect()}
    assert batch == want


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "x"), ("2024-01-01 20:00:00", "x"), ("2024-01-05 01:00:00", "y")], "at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = stateful.windowed_counts(stream, "at", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("x", 2), ("y", 1)]


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    rows = [(1, "pendente", 1, 1), (1, "processando", 2, 2), (2, "pendente", 1, 3)]
    more = [(2, "concluido", 9, 5), (1, "pendente", 1, 4)]  # the last is older than what is known of job 1
    frame = lambda x: spark.createDataFrame(x, "job_id long, status string, at long, event_id long")
    write = stateful.apply_transitions(f"{tmp_path}/jobs")
    write(frame(rows), 0)
    write(frame(more), 1)
    state = lambda: sorted(map(tuple, stateful.current(spark, f"{tmp_path}/jobs").collect()))
    want = [(1, "processando", 2), (2, "concluido", 9)]
    assert state() == want
    write(frame(more), 1)
    write(frame(rows[::-1]), 0)
    assert state() == want and spark.read.parquet(f"{tmp_path}/jobs").count() == 4


def test_each_job_is_claimed_once(spark, tmp_path):
    batches = [[(1, "a", 5.0), (2, "a", 4.0), (3, "b", 1.0)], [(4, "b", 0.5), (5, "b", 9.0)], []]
    write = stateful.claims(f"{tmp_path}/queue", "kind")
    frame = lambda x: spark.createDataFrame(x, "job_id long, kind string, at double")
    for k in (0, 1, 1, 2, 1, 2):  # epochs 1 and 2 come again
        write(frame(batches[k]), k)
    got = sorted((r.epoch, r.kind, r.job_id) for r in spark.read.parquet(f"{tmp_path}/queue/claimed").collect())
    assert got == [(0, "a", 2), (0, "b", 3), (1, "a", 1), (1, "b", 4), (2, "b", 5)]


def test_overwrite_replaces_only_its_runs(spark, tmp_path):
    from tidemark.sources.files import overwrite_runs

    path = f"{tmp_path}/runs"
    overwrite_runs(spark.createDataFrame([(1, 10), (2, 20)], "x long, execution_id long"), path)
    overwrite_runs(spark.createDataFrame([(9, 20)], "x long, execution_id long"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("x", "execution_id").collect())) == [(1, 10), (9, 20)]


def test_nothing_else_imports_the_training_subpackage():
    import subprocess
    import sys

    code = "import sys, tidemark.registry; sys.exit(any(m.startswith('tidemark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
