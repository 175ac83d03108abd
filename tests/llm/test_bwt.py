"""Merged transforms, and the meeting of hot anchors by windows, against brute force."""

import random
from bisect import bisect_left, bisect_right

import pytest

from tests.llm.test_operators import brute_words, by_id, corpus, table
from tidemark.llm import anchors, substring, suffix_dedup
from tidemark.llm.bwt import Shard, merged, repeated


def strings(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"a", b"ab", b"\x00\xff", b"abcd", bytes(range(256))])
    some = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 7))]
    return some + (some[:2] if rng.random() < 0.5 else []), rng.choice([1, 2, 3, 5, 8, 13]), rng.randint(1, 4)


@pytest.mark.parametrize("seed", range(60))
def test_transform_and_its_step_back(seed):
    some = strings(seed)[0]
    s = Shard(some)
    want = sorted((x[p:], i, p) for i, x in enumerate(some) for p in range(len(x) + 1))
    rows = list(zip(s.owner.tolist(), s.offset.tolist()))
    assert rows == [(i, p) for _, i, p in want]
    assert s.symbol.tolist() == [some[i][p - 1] + 1 if p else 0 for i, p in rows]
    row_of = {r: k for k, r in enumerate(rows)}
    assert s.before().tolist() == [row_of[i, p - 1] if p else -1 for i, p in rows]


@pytest.mark.parametrize("seed", range(120))
def test_merge(seed):
    some, width, k = strings(seed)
    k = min(k, len(some))
    shards = [Shard(some[j::k]) for j in range(k)]
    start, size, lcp = merged(shards, width)
    suffixes = [some[j::k][o][p:] for j, s in enumerate(shards) for o, p in zip(s.owner, s.offset)]
    keys = [tuple(c + 1 for c in x[:width]) + ((0,) if len(x) < width else ()) for x in suffixes]
    order = sorted(keys)
    for key, a, n in zip(keys, start, size):
        assert (a, a + n) == (bisect_left(order, key), bisect_right(order, key))
    for i in range(1, len(order)):
        a, b = order[i - 1], order[i]
        common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[i] == (width if a == b else common)
    seen = {}
    for x in some:
        for p in range(len(x) - width + 1):
            seen[x[p : p + width]] = seen.get(x[p : p + width], 0) + 1
    assert [r.tolist() for r in repeated(some, width, k)] == [[p for p in range(len(x) - width + 1) if seen[x[p : p + width]] > 1] for x in some]


def test_hot_anchors_change_nothing(spark, monkeypatch):
    texts = corpus()
    words = texts[0].split() or ["x"]
    passage = " ".join(words[i % len(words)] + str(i) for i in range(70))
    texts += [f"{i} begins {passage} and {i * i} ends it with these words here" for i in range(12)] + [f"{i} {passage}" for i in range(5)]
    docs = table(spark, texts).repartition(3)
    cold = by_id(suffix_dedup.digests(docs))
    monkeypatch.setattr(anchors, "HOT", 1)
    monkeypatch.setattr(anchors, "SLICE", 500)
    monkeypatch.setattr(anchors, "HELD", 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    assert by_id(suffix_dedup.digests(docs)) == cold
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in by_id(substring.digests(docs)).items()} == brute_words(texts)


def test_what_stays_is_given(spark):
    same = "".join(chr(97 + i * i % 26) for i in range(500))
    got = by_id(suffix_dedup.digests(table(spark, [f"front {same} é", same + "é back", None])))
    assert [got[i].text for i in range(3)] == ["front  é", "é back", ""] and got[0].n_removed == 500
