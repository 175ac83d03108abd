"""Paged comments: stop rules against a plain loop, and a stream that is stopped and resumed against one full read."""

import random

import pytest

from tidemark.sources import paged

RULES = [{"limit": 7}, {"limit": 1000}, {"limit": 1000, "most_read": 13}, {"limit": 9, "after": "2024-01-05"}, {"limit": 5, "term": "Bom"}, {"limit": 50, "after": "2024-01-03", "term": "bom", "most_read": 20}]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for v in ("a", "b", "vídeo/3", "d"):
        for i in range({"a": 40, "b": 1, "vídeo/3": 25, "d": 10}[v]):
            out.append((v, f"{v}{i:03}", f"2024-01-{rng.randint(1, 9):02}" if rng.random() < 0.9 else None, rng.choice(["muito bom", "ruim", None, "BOM \"demais\"\n"])))
    return out


@pytest.fixture(scope="module")
def landed(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    paged.land(spark.createDataFrame(rows, "video string, comment_id string, published_at string, text string").repartition(3), path, page=10)
    return path


def plain(rows, limit, most_read=None, after=None, term=None):
    out = []
    for v in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: r[1])
        mine.sort(key=lambda r: r[2] or "", reverse=True)
        read = accepted = 0
        for k, (_, i, at, text) in enumerate(mine):
            if accepted >= limit or (most_read is not None and read >= most_read) or (k % 10 == 0 and any(r[5] == "date" and r[2] for r in out if r[0] == v)):
                break
            read += 1
            reason = "date" if after and (at is None or at < after) else "term" if term and term.lower() not in (text or "").lower() else None
            accepted += reason is None
            out.append((v, i, at, text, str(k // 10), reason))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", RULES)
def test_stop_rules(spark, rows, landed, options):
    df = paged.comments(spark, landed, **options)
    assert sorted(map(tuple, df.collect()), key=repr) == plain(rows, **options)
    assert df.rdd.getNumPartitions() == 4


def test_a_resumed_stream_is_one_full_read(spark, rows, landed, tmp_path):
    options = {"limit": 22, "after": "2024-01-02"}

    def go(batches):
        """Runs until so many micro-batches are committed, then stops the query."""
        spark.dataSource.register(paged.CommentPages)
        stream = spark.readStream.format("comment_pages").options(path=landed, pages="1", **{k: str(v) for k, v in options.items()}).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
        import time

        until = time.time() + 60
        while time.time() < until and q.isActive and len([p for p in q.recentProgress if p["numInputRows"]]) < batches:
            time.sleep(0.2)
        got = len([p for p in q.recentProgress if p["numInputRows"]])
        q.stop()
        return got

    want = plain(rows, **options)
    assert go(1) >= 1
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < first < len(want)
    go(2)
    go(1 if spark.read.parquet(f"{tmp_path}/out").count() < len(want) else 0)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*[c.split()[0] for c in paged.SCHEMA.split(", ")]).collect()), key=repr) == want
