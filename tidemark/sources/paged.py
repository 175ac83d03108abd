"""Comments behind a paged interface as a Spark data source, in batch and as a stream that can be resumed.

A client hands out the pages of a video, newest comments first, under tokens. A batch read has one partition a video and stops as a
collection does: at `limit` accepted comments, at `most_read` read ones, or after the page with the first dated comment older than
`after`. A comment is left out for the first rule that it fails: its date (none counts as too old), then its term. Rows that are left
out come too, with the reason, so that every count of a collection can be drawn from the result; comments behind the stop don't.

A stream reads `pages` pages of every video in each micro-batch. Its offset holds, for each video, the token of the next page and
what was read and accepted so far: a query that is started again goes on where the last committed batch ended and stops at the same
comment as a batch read. Micro-batches that are planned but not committed are read again from the same tokens.

Pages come from landed files, one folder a video and one JSON file a page ({"items": [...], "next": token or null}), through
pyarrow's file systems, so any store that these reach will do; land() writes such pages from a table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = 100  # fixed value: comments of a page at most
FIRST = "0"
SCHEMA = "video string, comment_id string, published_at string, text string, page string, reason string"


class LandedPages:
    """Pages from files under a folder."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def folder(self, video: str) -> str:
        return f"{self.root}/{hashlib.sha256(video.encode()).hexdigest()}"

    def videos(self) -> list[str]:
        with self.system.open_input_stream(f"{self.root}/videos.json") as f:
            return json.loads(f.read())

    def page(self, video: str, token: str) -> tuple[list[dict], str | None]:
        with self.system.open_input_stream(f"{self.folder(video)}/{token}.json") as f:
            got = json.loads(f.read())
        return got["items"], got["next"]


@dataclass
class Progress:
    """What a collection of one video has come to; token None: it is over."""

    token: str | None = FIRST
    read: int = 0
    accepted: int = 0


@dataclass(frozen=True)
class Rules:
    limit: int
    most_read: int | None = None
    after: str | None = None
    term: str | None = None

    def reason(self, item: dict) -> str | None:
        if self.after is not None and (item.get("published_at") is None or item["published_at"] < self.after):
            return "date"
        if self.term is not None and self.term.lower() not in (item.get("text") or "").lower():
            return "term"
        return None


def collect(client: LandedPages, video: str, rules: Rules, start: Progress, pages: int | None = None) -> Iterator[tuple | Progress]:
    """Rows of the next pages (all, if none is given), then the progress that they lead to."""
    p, done = Progress(**asdict(start)), 0
    while p.token is not None and (pages is None or done < pages):
        items, following = client.page(video, p.token)
        old = False
        for item in items:
            if p.accepted >= rules.limit or (rules.most_read is not None and p.read >= rules.most_read):
                break
            p.read += 1
            reason = rules.reason(item)
            old = old or (reason == "date" and item.get("published_at") is not None)
            p.accepted += reason is None
            yield video, item["id"], item.get("published_at"), item.get("text"), p.token, reason
        over = old or p.accepted >= rules.limit or (rules.most_read is not None and p.read >= rules.most_read)
        p.token, done = None if over else following, done + 1
    yield p


class VideoPart(InputPartition):
    def __init__(self, video: str, start: Progress, pages: int | None):
        super().__init__(video)
        self.video, self.start, self.pages = video, start, pages


class _Reads:
    def __init__(self, options: dict):
        self.client = options["path"]
        number = lambda k: int(options[k]) if options.get(k) else None
        self.rules = Rules(number("limit") or PAGE, number("most_read"), options.get("after"), options.get("term"))
        self.pages = number("pages") or 1

    def read(self, partition: VideoPart) -> Iterator[tuple]:
        for x in collect(LandedPages(self.client), partition.video, self.rules, partition.start, partition.pages):
            if not isinstance(x, Progress):
                yield x


class BatchReader(_Reads, DataSourceReader):
    def partitions(self) -> list[VideoPart]:
        return [VideoPart(v, Progress(), None) for v in LandedPages(self.client).videos()]


class StreamReader(_Reads, DataSourceStreamReader):
    """Offsets are planned by counting, on the driver, what the next pages hold: `pages` pages a video, no text is kept."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {v: asdict(Progress()) for v in LandedPages(self.client).videos()}

    def latestOffset(self) -> dict:
        client, now = LandedPages(self.client), self.known or self.initialOffset()
        out = {}
        for video, p in now.items():
            *_, end = collect(client, video, self.rules, Progress(**p), self.pages)
            out[video] = asdict(end)
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[VideoPart]:
        self.known = end
        return [VideoPart(v, Progress(**p), self.pages) for v, p in start.items() if p != end[v]]

    def commit(self, end: dict) -> None:
        pass


class CommentPages(DataSource):
    """spark.read.format("comment_pages"): options path, limit, most_read, after, term; pages (a micro-batch) for streams."""

    @classmethod
    def name(cls) -> str:
        return "comment_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def comments(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(CommentPages)
    return spark.read.format("comment_pages").options(path=path, **{k: str(v) for k, v in options.items() if v is not None}).load()


def land(rows: DataFrame, path: str, page: int = PAGE) -> None:
    """Writes rows (video, comment_id, published_at as text, text) as pages: a task numbers and writes the comments of its videos, newest
    first, a page in memory at a time. Undated comments come last, ties by id."""
    parts = rows.select(F.col("video").cast("string").alias("video"), F.col("comment_id").cast("string").alias("id"), F.col("published_at").cast("string").alias("published_at"), F.col("text").cast("string").alias("text"))
    ordered = parts.where("video is not null").repartition("video").sortWithinPartitions("video", F.col("published_at").desc_nulls_last(), "id")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = LandedPages(path)
        video, items, at, seen = None, [], 0, []

        def flush(last: bool) -> None:
            nonlocal items, at
            client.system.create_dir(client.folder(video), recursive=True)
            with client.system.open_output_stream(f"{client.folder(video)}/{at}.json") as f:
                f.write(json.dumps({"items": items, "next": None if last else str(at + 1)}).encode())
            items, at = [], at + 1

        for f in frames:
            for r in f.astype(object).where(f.notna(), None).to_dict("records"):
                v = r.pop("video")
                if v != video:
                    if video is not None:
                        flush(True)
                    video, at = v, 0
                    seen.append(v)
                elif len(items) == page:
                    flush(False)
                items.append(r)
        if video is not None:
            flush(True)
        yield pd.DataFrame({"video": seen})

    landed = ordered.mapInPandas(write, "video string").orderBy("video").collect()  # a row a video
    client = LandedPages(path)
    client.system.create_dir(client.root, recursive=True)
    with client.system.open_output_stream(f"{client.root}/videos.json") as f:
        f.write(json.dumps([r["video"] for r in landed]).encode())
