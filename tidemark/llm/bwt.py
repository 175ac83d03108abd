"""Burrows-Wheeler transforms of shards of byte strings, merged by interleave refinement.

A shard's transform lists, for every suffix in order, the symbol before it; counting symbols gives the row of the suffix
one longer (the LF step). Shards are merged without sorting their suffixes again: the interleave starts as one block a first symbol
and is refined one symbol of common prefix a round. A block is a run of rows of every shard. Where a block was split in
the last round, the rows that the LF step reaches from its parts split their own blocks in the same order, and each new border is
the common prefix of its two neighbours. Rows of the largest part needn't be visited, as what no other part reaches
belongs to it; blocks of one row, and blocks whose suffixes weren't told apart further on, cost nothing. So every row
is visited about log(n) times in all, not once a round.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of nine bits compared at once


class Shard:
    """Transform of the strings: per row the symbol before the suffix (0: none), its string and its offset there."""

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        ends = np.cumsum(lengths + 1) - 1  # places of the terminators
        total = int(ends[-1]) + 1 if len(strings) else 0
        inside = np.ones(total, dtype=bool)
        inside[ends] = False
        text = np.zeros(total, dtype=np.uint16)
        text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1
        owner = np.repeat(np.arange(len(strings)), lengths + 1)
        offset = np.arange(total) - (ends - lengths)[owner]
        order = self._sorted(text, lengths[owner] - offset)
        self.symbol = np.where(offset[order] > 0, text[order - 1], 0).astype(np.uint16)
        self.owner, self.offset, self.length = owner[order], offset[order], lengths

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Suffixes in order, each up to its terminator; equal ones in order of their strings."""
        n = len(text)
        padded = np.r_[text, np.zeros(PACK, np.uint16)]
        key = np.zeros(n, dtype=np.uint64)
        for k in range(PACK):
            key = (key << np.uint64(9)) | np.where(k < left, padded[k : k + n], 0).astype(np.uint64)
        order = np.argsort(key)
        new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        open_ = order[~(new & np.r_[new[1:], True])] if n else order
        h = PACK
        while len(open_ := open_[left[open_] >= h]):
            pair = rank[open_] * (n + 1) + rank[open_ + h]
            by = np.argsort(pair)
            open_, pair = open_[by], pair[by]
            old = rank[open_]
            block = np.r_[True, old[1:] != old[:-1]]
            part = np.r_[True, pair[1:] != pair[:-1]]
            # what ended within h symbols sorts first in its block, and only with its equals: blocks hold one or the other
            at = np.arange(len(open_))
            rank[open_] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(block, at, 0))
            open_ = open_[~(part & np.r_[part[1:], True])]
            h *= 2
        return np.argsort(rank, kind="stable")

    def before(self) -> np.ndarray:
        """LF step: the row of the suffix one symbol longer, -1 at the start of a string."""
        by = np.argsort(self.symbol, kind="stable")
        out = np.empty(len(by), dtype=np.int64)
        out[by] = np.arange(len(by))
        out[self.symbol == 0] = -1
        return out


def spread(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges."""
    ends = np.cumsum(count)
    return np.repeat(lo - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, lcp) of the merged transform, up to so many symbols: for each row of the shards, end to end, the
    merged place and size of its block of equal prefixes, and for each merged place the common prefix with the one before."""
    k = len(shards)
    base = np.cumsum([0, *(len(s.symbol) for s in shards)])
    n = int(base[-1])
    before = np.concatenate([np.where((b := s.before()) < 0, -1, b + o) for s, o in zip(shards, base)]).astype(np.int32)
    of = np.repeat(np.arange(k, dtype=np.int32), np.diff(base))
    counts = np.stack([np.bincount(s.symbol, minlength=257) for s in shards], axis=1)
    used = np.flatnonzero(counts.sum(axis=1))
    counts = counts[used]
    blocks = len(used)
    room = n + 1
    count = np.zeros((room, k), dtype=np.int32)
    count[:blocks] = counts
    lo = np.zeros((room, k), dtype=np.int32)
    lo[:blocks] = np.cumsum(counts, axis=0) - counts + base[:-1]
    size, start = np.zeros(room, dtype=np.int32), np.zeros(room, dtype=np.int32)
    size[:blocks] = counts.sum(axis=1)
    start[:blocks] = np.cumsum(size[:blocks]) - size[:blocks]
    label = np.concatenate([np.repeat(np.arange(blocks, dtype=np.int32), counts[:, j]) for j in range(k)])
    lcp = np.full(n + 1, depth, dtype=np.int32)
    lcp[start[:blocks]] = 0
    big = int(np.argmax(size[:blocks])) if blocks else 0
    others = np.flatnonzero(np.arange(blocks) != big)
    rows = spread(lo[others].ravel(), count[others].ravel())
    place = start[label[rows]]
    front = place < start[big]
    for h in range(1, depth):
        to = before[rows]
        ok = to >= 0
        ok[ok] = size[label[to[ok]]] > 1
        to, place, front = to[ok], place[ok], front[ok]
        if not len(to):
            break
        key = label[to].astype(np.int64) * (n + 1) + place
        by = np.argsort(key)
        to, key, front = to[by], key[by], front[by]
        old = label[to]
        sub = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held = np.diff(np.r_[sub, len(to)])
        parent = old[sub]
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        parts = np.diff(np.r_[first, len(sub)])
        split = ~((parts == 1) & (np.add.reduceat(held, first) == size[parent[first]]))
        if not split.all():  # every row of the block goes on alike: nothing to tell apart
            keep = np.repeat(split, parts)
            rows_kept = np.repeat(keep, held)
            to, front, sub_front = to[rows_kept], front[rows_kept], front[sub][keep]
            held, parent = held[keep], parent[keep]
        else:
            sub_front = front[sub]
        if not len(to):
            break
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        parts = np.diff(np.r_[first, len(parent)])
        of_parent = np.repeat(np.arange(len(first)), parts)
        whole = parent[first]
        cum = np.cumsum(held) - held
        within = cum - cum[first][of_parent]
        touched = np.add.reduceat(held, first)
        rest = size[whole] - touched
        ahead = np.add.reduceat(np.where(sub_front, held, 0), first)
        origin = start[whole].copy()
        begin = origin[of_parent] + within + np.where(sub_front, 0, rest[of_parent])
        # a block of which nothing is left gives its number to its first part
        new = np.ones(len(held), dtype=bool)
        new[first[rest == 0]] = False
        fresh = np.where(new, blocks - 1 + np.cumsum(new), parent)
        blocks += int(new.sum())
        of_sub = np.repeat(np.arange(len(held)), held)
        label[to] = fresh[of_sub]
        cell = of_sub * k + of[to]
        c = np.bincount(cell, minlength=len(held) * k)
        total = np.bincount(cell, weights=to, minlength=len(held) * k)
        lowest = np.where(c > 0, np.rint((total - c * (c - 1) / 2) / np.maximum(c, 1)), 0).reshape(-1, k)
        c = c.reshape(-1, k)
        whole_cell = of_parent[of_sub] * k + of[to]
        lo[whole] += np.bincount(whole_cell[front], minlength=len(first) * k).reshape(-1, k)
        count[whole] -= np.bincount(whole_cell, minlength=len(first) * k).reshape(-1, k)
        size[whole], start[whole] = rest, origin + ahead
        lo[fresh], count[fresh], size[fresh], start[fresh] = lowest, c, held, begin
        borders = np.r_[begin, (origin + ahead)[rest > 0]]
        inner = np.r_[begin != origin[of_parent], (ahead > 0)[rest > 0]]
        lcp[borders[inner]] = h
        # the largest part of each block is left out of the next round
        most = np.maximum.reduceat(held, first)
        drop_rest = rest >= most
        largest = np.flatnonzero(held == most[of_parent])
        largest = largest[np.r_[True, of_parent[largest][1:] != of_parent[largest][:-1]]]
        out_start = np.where(drop_rest, origin + ahead, begin[largest])
        use = np.ones(len(held), dtype=bool)
        use[largest[~drop_rest]] = False
        mine = use[of_sub]
        again = np.flatnonzero(~drop_rest & (rest > 0))
        more = spread(lo[whole[again]].ravel(), count[whole[again]].ravel())
        rows = np.concatenate([to[mine], more])
        place = start[label[rows]]
        front = place < np.concatenate([out_start[of_parent[of_sub[mine]]], np.repeat(out_start[again], rest[again])])
    return start[label], size[label], lcp[:n]


def repeated(strings: list[bytes], width: int, shards: int = 4) -> list[np.ndarray]:
    """For each string the offsets, ascending, of the width-byte substrings that occur more than once in all strings."""
    shards = max(1, min(shards, len(strings)))
    dealt = [Shard(strings[j::shards]) for j in range(shards)]
    _, size, _ = merged(dealt, width)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(strings)
    at = 0
    for j, s in enumerate(dealt):
        own = size[at : at + len(s.symbol)]
        at += len(s.symbol)
        hit = (own > 1) & (s.offset <= s.length[s.owner] - width)
        owner, offset = s.owner[hit], s.offset[hit]
        by = np.lexsort((offset, owner))
        owner, offset = owner[by], offset[by]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
        for a, b in zip(cut, [*cut[1:], len(owner)]):
            out[j + shards * int(owner[a])] = offset[a:b]
    return out
