"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms.

Segments that can hold repeated windows meet by anchor (see `anchors`), so the transforms needn't cover what occurs once. A task
takes the groups of several anchors at once, deals their distinct segments to shards, builds each shard's transform and
merges them by interleave refinement (see `bwt`) up to a common prefix of 400 bytes: suffixes that are not told apart by
then are the repeated intervals. A segment equal to another is repeated whole and isn't refined.

Edge cases: null text counts as empty; texts under 400 bytes lose nothing; equal texts of 400 bytes or more are removed
whole, the first too; repeated rows of a doc_id count once and share the outcome; rows that repeat a
doc_id with another text, and rows without doc_id, are kept whole; what stays need not be valid UTF-8: the digest is of
the bytes, and in the column text ill-formed parts are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import BYTES, Judge, merged, repeats, sliced
from .bwt import repeated
from .substring import runs_of

SIDE = (BYTES.window - BYTES.gram) // 2
CHUNK = 2 << 20  # bytes of distinct segments whose transforms are merged at once, but one group at least


class Anywhere(Judge):
    """Windows of the segments of one anchor that occur again anywhere."""

    def __init__(self):
        self.held: list[tuple[list, bytes]] = []
        self.size = 0

    def add(self, group: list[tuple]) -> list[tuple]:
        by: dict[bytes, list] = {}
        for g in group:
            by.setdefault(g[3], []).append(g)
        found = []
        for rows in by.values():
            if len(rows) > 1 or rows[0][4] > 1:
                found += [(doc, start, start + size - 1) for doc, start, size, _, _, _ in rows]
        # a window reaches SIDE bytes or more beyond its anchor to one side, so segments with a common window agree there
        sides = {text: (text[at - SIDE : at] if (at := rows[0][5]) >= SIDE else None, text[at + BYTES.gram :][:SIDE]) for text, rows in by.items()}
        before, after = (Counter(s[k] for s in sides.values()) for k in (0, 1))
        for text, (left, right) in sides.items():
            if (left is not None and before[left] > 1) or (len(right) == SIDE and after[right] > 1):
                self.held.append((by[text], text))
                self.size += len(text)
        if self.size >= CHUNK:
            found += self.finish()
        return found

    def finish(self) -> list[tuple]:
        held, self.held, self.size = self.held, [], 0
        if not held:
            return []
        found = []
        for (rows, _), places in zip(held, repeated([t for _, t in held], BYTES.window)):
            if len(rows) == 1 and rows[0][4] == 1 and len(places):
                doc, start = rows[0][:2]
                found += [(doc, start + a, start + z) for a, z in runs_of(places.tolist())]
        return found


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what stays) of each row."""
    judged = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), BYTES, Anywhere, first_stays=False)

    def run(batches):
        for b in sliced(batches, 1):
            out = []
            for text, runs, copy in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text = text or b""
                spans = [(0, len(text))] if copy and len(text) >= BYTES.window else merged(runs or [])
                kept = b"".join([text[a:z] for a, z in zip([0, *(hi for _, hi in spans)], [*(lo for lo, _ in spans), len(text)])])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return judged.select("doc_id", "_text", "_runs", "_copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
