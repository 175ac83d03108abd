"""Meeting places for repeated windows.

A window is L consecutive units (words or bytes) of a document. Each window picks one anchor: the run of K units in it with
the smallest hash, leftmost of equals. Equal windows pick equal anchors at the same place, so only occurrences of
a repeated anchor can hold repeated windows, and those with the same anchor meet by its hash. The windows of one
anchor occurrence are neighbours; together they are its segment.

Everything is dealt by document or by anchor hash. Within a batch of documents equal anchors and equal segments are joined before
the shuffle, so a passage that a third of all documents hold is sent once a batch. The text itself
is dealt once, by doc_id; Spark reuses that exchange in every step that reads it.

Segments of one anchor are judged together, in a task that holds one bounded group at a time: anchors with more than HOT
occurrences don't meet by anchor. Their segments are dealt by (doc_id, start), cut into windows, and the windows meet by
a 128-bit digest, where a group is a few numbers a batch and is counted by a window function that can spill.
Which anchors are hot is told by a table of BITS bits, the same for every row, so that equal windows always go one way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .io import partitions, released

BLOCK = 1 << 20  # units hashed at once
INDEX = 24  # low bits of a hash that give way to the position
NO_ID = -(1 << 63)  # stands for a missing doc_id
HOT = 4096  # occurrences of an anchor up to which its segments meet in one group
BITS = 1 << 16  # bound of the broadcast table of hot anchors
SLICE = 4 << 20  # bytes of text taken from a batch at once
HELD = 16 << 20  # bytes of distinct segments held before they are sent
M = 0x9E3779B97F4A7C15


def power(n: int) -> np.uint64:
    return np.uint64(pow(M, n, 1 << 64))


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of so many values, by doubling; unmixed."""
    out, have, block, size = None, 0, values, 1
    while True:
        if width & size:
            if out is None:
                out, have = block, size
            else:
                n = len(values) - have - size + 1
                out, have = out[:n] * power(size) + block[have : have + n], have + size
        size *= 2
        if size > width:
            return out[: len(values) - width + 1]
        half = size // 2
        n = len(values) - size + 1
        block = block[:n] * power(half) + block[half : half + n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, size = len(v) - width + 1, 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


@dataclass(frozen=True)
class Kind:
    """What a unit is: values gives one hash a unit of a text, cut the bytes from unit a up to unit b."""

    window: int
    gram: int
    split: Callable[[bytes], object]
    values: Callable[[object], np.ndarray]
    cut: Callable[[object, int, int], bytes]


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


BYTE_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)


def byte_values(text: bytes) -> np.ndarray:
    return BYTE_TABLE[np.frombuffer(text, dtype=np.uint8)]


WORDS = Kind(20, 8, bytes.split, word_values, lambda w, a, b: b" ".join(w[a:b]))
BYTES = Kind(400, 32, lambda t: t, byte_values, lambda t, a, b: t[a:b])


def segments(kind: Kind, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (document, first window, last window, anchor place, anchor hash) of concatenated documents that end at ends."""
    size, k = kind.window, kind.gram
    found = []
    for lo in range(0, max(0, len(values) - size + 1), BLOCK):
        part = values[lo : lo + BLOCK + size - 1]
        h = mixed(rolled(part, k))
        low = np.uint64((1 << INDEX) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(key, size - k + 1) & low).astype(np.int64)
        at = np.arange(len(place)) + lo
        doc = np.searchsorted(ends, at, side="right")
        ok = at + size <= ends[np.minimum(doc, len(ends) - 1)]
        at, doc, place = at[ok], doc[ok], place[ok]
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[new[1:] - 1, len(at) - 1]
        found.append(np.stack([doc[new], at[new], at[last], place[new] + lo, h[place[new]].view(np.int64)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)


def batch_segments(kind: Kind, texts: list[bytes | None]) -> Iterator[tuple[list[int], list[object], np.ndarray]]:
    """(row numbers, split texts, segments with places counted within the document) for groups of long enough texts."""
    rows, units, values, total = [], [], [], 0

    def group():
        ends = np.cumsum([len(v) for v in values])
        s = segments(kind, np.concatenate(values), ends)
        # blocks end within documents: a run of windows that a block cut in two stays two segments, in every step alike
        s[:, 1:4] -= np.r_[0, ends[:-1]][s[:, 0]][:, None]
        return rows, units, s

    for n, text in enumerate(texts):
        u = kind.split(text or b"")
        if len(u) >= kind.window:
            v = kind.values(u)
            if total and total + len(v) > BLOCK:
                yield group()
                rows, units, values, total = [], [], [], 0
            rows.append(n)
            units.append(u)
            values.append(v)
            total += len(v)
    if rows:
        yield group()


def _table(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sliced(batches, column: int, limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a part has about limit bytes in the binary column, or one row; nothing is copied."""
    limit = limit or SLICE
    for b in batches:
        if b.num_rows:
            sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
            cut = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                yield b.slice(int(lo), int(hi - lo))


def once(batches) -> Iterator[pa.RecordBatch]:
    """The first row of each id in the first column; of a partition that holds all rows of an id."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for d in b.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield b if all(keep) else b.filter(pa.array(keep))


def shared_anchors(docs: DataFrame, kind: Kind, parts: int) -> DataFrame:
    """(doc_id, place, bit) of the anchor occurrences whose anchor occurs twice or more, and rows without doc_id that name the bits of hot
    anchors; docs starts with an id, of which the first row counts, and the text as binary, and is dealt by the id."""

    def post(batches):
        for b in sliced(once(batches), 1):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            got = [np.stack([s[:, 4], ids[np.array(rows)][s[:, 0]], s[:, 3]], axis=1) for rows, _, s in batch_segments(kind, b.column(1).to_pylist())]
            if not got:
                continue
            g = np.concatenate(got)
            g = g[np.argsort(g[:, 0], kind="stable")]
            first = np.r_[True, g[1:, 0] != g[:-1, 0]]
            size = np.diff(np.r_[np.flatnonzero(first), len(g)])
            # the first of a batch carries the number of all; the others are known to be shared: dealt by document, and done
            count = np.zeros(len(g), dtype=np.int32)
            count[first] = size
            key = np.where(first, g[:, 0], g[:, 1] * 31 + g[:, 2])
            yield _table({"key": (key, pa.int64()), "doc_id": (g[:, 1], pa.int64()), "place": (g[:, 2], pa.int64()), "count": (count, pa.int32())})

    def meet(batches):
        got = [np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1) for b in batches]
        if not got:
            return
        g = np.concatenate(got)
        done, g = g[g[:, 3] == 0], g[g[:, 3] > 0]
        g = g[np.argsort(g[:, 0], kind="stable")]
        if len(g):
            cut = np.flatnonzero(np.r_[True, g[1:, 0] != g[:-1, 0]])
            size = np.add.reduceat(g[:, 3], cut)
            done = np.concatenate([done, g[np.repeat(size > 1, np.diff(np.r_[cut, len(g)]))]])
            hot = np.unique(g[cut[size > HOT], 0] % BITS)
            none = pa.nulls(len(hot), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(hot, pa.int32())], ["doc_id", "place", "bit"])
        for lo in range(0, len(done), 1 << 16):
            d = done[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 1]), pa.array(d[:, 2]), pa.nulls(len(d), pa.int32())], ["doc_id", "place", "bit"])

    posted = docs.mapInArrow(released(post), "key long, doc_id long, place long, count int")
    return posted.repartition(parts, "key").mapInArrow(released(meet), "doc_id long, place long, bit int")


SENT = "key long, doc_id long, start long, size int, payload binary, copies int, at int"


def shared_segments(marked: DataFrame, kind: Kind) -> DataFrame:
    """Segments of the marked anchors; marked starts with id, text, places and is dealt by the id, of which the first row counts. Equal segments of a batch are sent once.

    (key, doc_id, start, size, payload, copies, at): size windows from start, the anchor at units later; without payload a segment is equal to one
    of the same batch that is sent, with the smaller (doc_id, start) and its number of copies."""

    def rows(seen: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        out = []
        for payload, found in seen.items():
            found.sort()
            doc, start, size, key, place = found[0]
            out.append((key, doc, start, size, payload, len(found), place - start))
            out += [(hash((d, a)), d, a, n, None, 0, 0) for d, a, n, _, _ in found[1:]]
        for lo in range(0, len(out), 1 << 14):
            cols = list(zip(*out[lo : lo + (1 << 14)]))
            yield _table({"key": (cols[0], pa.int64()), "doc_id": (cols[1], pa.int64()), "start": (cols[2], pa.int64()), "size": (cols[3], pa.int32()), "payload": (cols[4], pa.binary()), "copies": (cols[5], pa.int32()), "at": (cols[6], pa.int32())})

    def post(batches):
        seen: dict[bytes, list] = {}
        held = 0
        for b in sliced(once(batches), 1):
            ids, places = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, units, s in batch_segments(kind, b.column(1).to_pylist()):
                for d, n in enumerate(at):
                    own = s[np.searchsorted(s[:, 0], d) : np.searchsorted(s[:, 0], d, side="right")]
                    own = own[np.isin(own[:, 3], places[n])]
                    for _, a, z, place, key in own.tolist():
                        payload = kind.cut(units[d], a, z + kind.window)
                        if (found := seen.get(payload)) is None:
                            found = seen[payload] = []
                            held += len(payload)
                        found.append((ids[n], a, z - a + 1, key, place))
            if held > HELD:
                yield from rows(seen)
                seen, held = {}, 0
        yield from rows(seen)

    return marked.mapInArrow(released(post), SENT)


class Judge:
    """Told the groups (doc_id, start, size, payload, copies, at) of one anchor after the other, each sorted by the first two; answers with
    (doc_id, first window, last window) of those that repeat, at once or when finished."""

    def add(self, group: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        return []


def resolved(sent: DataFrame, hot: DataFrame, kind: Kind, parts: int, judge: Callable[[], Judge], first_stays: bool) -> DataFrame:
    """(doc_id, lo, hi): runs of units under repeated windows. hot has the column bit, BITS rows at most. If the first stays, the earliest
    of equal windows isn't repeated."""
    told = sent.join(F.broadcast(hot.withColumnRenamed("bit", "_bit")), (F.pmod("key", F.lit(BITS)) == F.col("_bit")) & F.col("payload").isNotNull(), "left")
    hot_row = F.col("_bit").isNotNull()
    dealt = told.select(F.when(hot_row, F.xxhash64("doc_id", "start")).otherwise(F.col("key")).alias("key"), "doc_id", "start", "size", "payload", "copies", "at", hot_row.alias("hot"))

    def meet(batches):
        judged, out, group = judge(), [], []

        def flush():
            cols = list(zip(*out))
            out.clear()
            return _table({"digest": (cols[0], pa.binary()), "doc_id": (cols[1], pa.int64()), "lo": (cols[2], pa.int64()), "hi": (cols[3], pa.int64()), "copies": (cols[4], pa.int32())})

        def put(found):
            out.extend((None, d, a, z + kind.window, 0) for d, a, z in found)

        for b in sliced(batches, 4):
            for r in zip(*(c.to_pylist() for c in b.columns)):
                key, doc, a, n, payload, copies, _, is_hot = r
                if payload is None:
                    out.append((None, doc, a, a + n - 1 + kind.window, 0))
                elif is_hot:
                    units = kind.split(payload)
                    out.extend((xxhash.xxh3_128_digest(kind.cut(units, i, i + kind.window)), doc, a + i, a + i + kind.window, copies) for i in range(n))
                else:
                    if group and group[0][0] != key:
                        put(judged.add([g[1:7] for g in group]))
                        group = []
                    group.append(r)
                if len(out) >= 1 << 16:
                    yield flush()
        if group:
            put(judged.add([g[1:7] for g in group]))
        put(judged.finish())
        if out:
            yield flush()

    found = dealt.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(released(meet), "digest binary, doc_id long, lo long, hi long, copies int")
    # runs that are decided are alone with a key of their own
    alone = F.coalesce("digest", F.concat(F.lit("run").cast("binary"), F.hex("doc_id").cast("binary"), F.lit("-").cast("binary"), F.hex("lo").cast("binary")))
    same = W.partitionBy("_same")
    counted = found.withColumn("_same", alone).withColumn("_least", F.min(F.struct("doc_id", "lo")).over(same)).withColumn("_n", F.sum("copies").over(same))
    # copies within a batch beyond the first are decided already
    again = (F.col("_least") != F.struct("doc_id", "lo")) if first_stays else (F.col("_n") > 1)
    return counted.where(F.col("digest").isNull() | again).select("doc_id", "lo", "hi")


def merged(runs: list) -> list[tuple[int, int]]:
    """Overlapping and touching runs joined."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, kind: Kind, judge: Callable[[], Judge], first_stays: bool) -> DataFrame:
    """docs, its text as the binary column _text, with the columns _runs (units under windows that repeat) and _copy
    ('first': of equal texts that occur again, 'later': equal to an earlier one, else null).

    Equal texts are compared once, by the row with the smallest doc_id; of a doc_id with several
    texts only the one with the smallest digest takes part, the other rows get no runs."""
    parts = partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    others = [c for c in docs.columns if c != "text"]
    # a key without nulls: joins then need no filter of their own below the exchange, and all of them can reuse it
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_key")
    dealt = docs.select(*others, key, F.col("text").cast("binary").alias("_text"), F.md5(text).alias("_md5")).repartition(parts, "_key")
    chosen = docs.select("doc_id", F.md5(text).alias("_own")).where("doc_id is not null").groupBy("doc_id").agg(F.min("_own").alias("_own"))
    again = chosen.groupBy("_own").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    info = chosen.join(again, "_own", "left").select(
        F.col("doc_id").alias("_id"), "_own", F.when(F.col("_least") == F.col("doc_id"), "first").when(F.col("_least").isNotNull(), "later").alias("_copy")
    )
    rep = info.where("_copy is null or _copy = 'first'").select("_id", "_own")
    # ids of rep are unique; a semi-join would be moved below the repartition and shuffle the text on its own
    # equality of the digests is put so that it is no join key, or the repartition would be changed to both keys
    unique = dealt.join(rep, (F.col("_key") == F.col("_id")) & F.col("_md5").startswith(F.col("_own")))
    # all columns stay, though the steps read two: with fewer the exchange would be another one
    unique = unique.select("_key", "_text", "_md5", *others)

    found = shared_anchors(unique, kind, parts)
    marks = found.where("bit is null").groupBy(F.col("doc_id").alias("_mark_id")).agg(F.collect_list("place").alias("places"))
    hot = found.where("bit is not null").select("bit").distinct()
    marked = unique.join(marks, F.col("_key") == F.col("_mark_id")).select("_key", "_text", "places", "_md5", *others)
    runs = resolved(shared_segments(marked, kind), hot, kind, parts, judge, first_stays).groupBy(F.col("doc_id").alias("_run_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("_runs"))
    told = info.join(runs, F.col("_id") == F.col("_run_id"), "left").drop("_run_id")
    out = dealt.join(told, F.col("_key") == F.col("_id"), "left")
    mine = F.col("_md5") == F.col("_own")
    return out.withColumn("_runs", F.when(mine, F.col("_runs"))).withColumn("_copy", F.when(mine, F.col("_copy"))).drop("_id", "_own", "_md5", "_key")
