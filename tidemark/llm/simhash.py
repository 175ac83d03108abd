"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes; 3 differing bits touch 3 bytes at most, so linked fingerprints share at
least 5 of their 8 positional bytes, and with that every 4-subset of the shared positions. Single
positional bytes have posting lists of N/256, so the index is kept on 4 positional bytes at once:
C(8,4) = 35 postings a fingerprint, 2^32 lists each. In each list the shared bytes of two fingerprints are
tallied, those with 5 or more are verified by their differing bits, and only a spanning
forest of the links is handed on: a list of n distinct fingerprints yields n - 1 edges at most.
Exact copies share one fingerprint and are one vertex.

Edge cases: null or blank text has fingerprint zero and is linked like any other; one or two words count as one
shingle; repeated rows share a component; an empty table gives an empty result; null doc_ids keep their row
and are never the smallest id of a component unless it has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import stars
from .io import partitions, released

SUBSETS = list(combinations(range(8), 4))
MASKS = np.array([sum(0xFF << (8 * p) for p in s) for s in SUBSETS], dtype=np.uint64)
FLIPS = np.array([sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(64), n)], dtype=np.uint64)
PROBE = 8192  # distinct fingerprints in a list from which neighbours are looked up instead of compared


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and string columns to carry along, of each row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *extra])

    carried = "".join(f", `{c}` string" for c in extra)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *extra).mapInArrow(released(run), f"doc_id long, fp long{carried}")


def forest(values: np.ndarray, bits: int = 3) -> list[tuple[int, int]]:
    """Edges (member, first member) of the groups of distinct fingerprints that links of at most so many bits connect."""
    left, out = np.sort(values), []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            if len(left) > PROBE:
                cand = x ^ FLIPS
                at = np.minimum(np.searchsorted(left, cand), len(left) - 1)
                near = np.zeros(len(left), dtype=bool)
                near[at[left[at] == cand]] = True
            else:
                diff = left ^ x
                near = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
                near[near] = np.bitwise_count(diff[near]) <= bits
            if near.any():
                found = left[near]
                out += [(int(f), int(root)) for f in found]
                queue += list(found)
                left = left[~near]
    return out


def edges(prints: DataFrame, parts: int) -> DataFrame:
    """(a, b) of a spanning set of links between the distinct fingerprints in column fp."""

    def post(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            kept = fp[:, None] & MASKS
            # the positions are mixed into the key, so that lists of different subsets are told apart
            key = (kept * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(MASKS), dtype=np.uint64)) ^ (kept >> np.uint64(29))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(MASKS)).view(np.int64))], ["key", "fp"])

    def link(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= 3
        out = set(zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist()))
        for s, n in zip(cut[:-1][size > 2], size[size > 2]):
            out.update(forest(np.unique(fp[s : s + n])))
        if out:
            pairs = np.array(list(out), dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    posted = prints.select("fp").mapInArrow(released(post), "key long, fp long")
    return posted.repartition(parts, "key").mapInArrow(released(link), "a long, b long")


def rooted(prints: DataFrame) -> DataFrame:
    """fp, least (its smallest doc_id) and root (the fingerprint that names the component) of each distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = stars(edges(distinct, partitions(prints.sparkSession)))
    return distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row. Fingerprints are checkpointed: texts are read once."""
    prints = fingerprints(docs).checkpoint()
    roots = rooted(prints)
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = roots.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, own: str) -> DataFrame:
    """doc_id and own of the row that stands for each component: of those with a doc_id the smallest, by own among rows of one doc_id."""
    prints = fingerprints(docs.where("doc_id is not null"), own).checkpoint()
    named = prints.join(rooted(prints).select("fp", "root"), "fp")
    return named.groupBy("root").agg(F.min(F.struct("doc_id", own)).alias("_r")).select("_r.*")
