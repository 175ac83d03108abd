"""Removal of repeated passages of words, by suffix automata of the reference passages.

The segments that share an anchor are a shard: in order of (doc_id, start) each is streamed through the generalised suffix
automaton of the shard's earlier distinct segments. Where the matching statistic reaches the window length, that window starts
earlier; a segment with a new window joins the automaton. Segments equal to an earlier one need no
streaming. A shard's automaton is dropped after it, so memory is bounded by one anchor's distinct segments.

Automata of all earlier documents, broadcast shard by shard, would stream every document through every
shard, work that grows with the square of the corpus; dealing shards by anchor finds the same windows.

Edge cases: null text counts as empty (no words); texts under 20 words lose nothing; equal texts are removed
whole from the second doc_id on; repeated rows of a doc_id count once and share the outcome; rows that repeat a doc_id with
another text, and rows without doc_id, are kept whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .anchors import WORDS, Judge, merged, repeats, sliced
from .io import released


class SuffixAutomaton:
    """Generalised suffix automaton of strings of any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, symbol) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, symbols) -> None:
        last = 0
        for s in symbols:
            if (q := self.next[last].get(s)) is not None:  # the strings before have this prefix
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, s)
                continue
            state = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, s)
            last = state

    def matching(self, symbols):
        """Length of the longest suffix of each prefix that occurs in the strings."""
        state = n = 0
        for s in symbols:
            while state and s not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (q := self.next[state].get(s)) is not None:
                state, n = q, n + 1
            yield n


def runs_of(flags: list[int]):
    """(first, last) of each run of neighbours in an ascending list."""
    at = 0
    for k in range(1, len(flags) + 1):
        if k == len(flags) or flags[k] != flags[k - 1] + 1:
            yield flags[at], flags[k - 1]
            at = k


class Earlier(Judge):
    """Windows of the segments of one anchor that an earlier segment holds."""

    def add(self, group: list[tuple]) -> list[tuple]:
        seen: set[bytes] = set()
        automaton = None
        held: list[list[bytes]] = []
        found = []
        for doc, start, size, payload, _, _ in group:
            if payload in seen:
                found.append((doc, start, start + size - 1))
                continue
            symbols = payload.split()
            hits: list[int] = []
            if seen:
                if automaton is None:
                    automaton = SuffixAutomaton()
                for h in held:
                    automaton.add(h)
                held.clear()
                hits = [e - WORDS.window + 1 for e, n in enumerate(automaton.matching(symbols)) if n >= WORDS.window]
                found += [(doc, start + a, start + z) for a, z in runs_of(hits)]
            seen.add(payload)
            if len(hits) < size:
                held.append(symbols)
        return found


def cut_words(text: bytes | None, runs, copy, size: int) -> tuple[int, list[bytes]]:
    """Number of words and those that stay."""
    words = (text or b"").split()
    if copy == "later" and len(words) >= size:
        return len(words), []
    if not runs:
        return len(words), words
    keep = np.ones(len(words), dtype=bool)
    for lo, hi in merged(runs):
        keep[lo:hi] = False
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def remove(docs: DataFrame) -> DataFrame:
    """docs, with text replaced by its kept words joined by one space where words were removed, and three columns more:
    n_words, n_removed and kept_sha256."""
    judged = repeats(docs, WORDS, Earlier, first_stays=True)
    names = docs.columns
    fields = [docs.schema[c] for c in names]
    text_at = len(names) - 1  # where _text stands below

    def run(batches):
        for b in sliced(batches, text_at):
            get = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            n, gone, sha, texts = [], [], [], []
            for text, runs, copy in zip(get["_text"].to_pylist(), get["_runs"].to_pylist(), get["_copy"].to_pylist()):
                count, kept = cut_words(text, runs, copy, WORDS.window)
                joined = b" ".join(kept)
                n.append(count)
                gone.append(count - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined if count > len(kept) else text)
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else get[c] for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [*names, "n_words", "n_removed", "kept_sha256"])

    extra = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    return judged.select(*[c for c in names if c != "text"], "_text", "_runs", "_copy").mapInArrow(released(run), StructType([*fields, *extra]))


def digests(docs: DataFrame) -> DataFrame:
    return remove(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
