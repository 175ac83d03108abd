"""Conversation tries against brute force over all prefixes, with shards of a few turns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import registry, trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, depth int, shard string"


def label(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, label(role, text), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, cs in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(k))))
        out.append((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    rng = random.Random(9)
    say = lambda: rng.choice(["hi", "yes", "no", "été", "", "tell me more " * 3])
    rows = []
    for c in [*range(0, 260), *range(1000, 1040, 3), 10**12, 10**12 + 3]:
        if c % 5 == 0 and c % 3 == 0:
            continue  # families without base
        rows += [(c, t, rng.choice(["user", "assistant"]) if c % 4 else "user", say()) for t in range(rng.randint(1, 9))]
    for c in range(400, 520):  # copies, and a first turn of many
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    rows += [(c, t, "user", "open" if t == 0 else f"{c} {t}") for c in range(600, 700) for t in range(3)]
    rows += [(700, t, "user", f"long {t}") for t in range(300)] + [(701, t, "user", f"long {t}") for t in range(300)]
    rows += [(702, None, "user", "first"), (702, 0, None, None), (702, 0, None, None), (702, 0, "a", "tie"), (702, 0, "a", "tie 2"), (None, 0, "user", "none's"), (704, -3, None, "x"), (704, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard", [1, 40, 10**6])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = talks()
    df = trie.prefix_trie(frame(spark, rows))
    assert df.columns == trie.RESULT
    assert sorted(map(tuple, df.collect()), key=repr) == brute(rows)


def test_without_conversations(spark):
    assert trie.prefix_trie(frame(spark, [(None, 0, "user", "x")])).count() == 0
    rows = [(2, 0, "user", "x")]  # the base is absent and all own turns are replaced, unless none is
    assert sorted(map(tuple, trie.prefix_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_louds():
    paths = [[1], [1, 2], [1, 2, 5], [1, 3], [4], [4, 1]]
    t = trie.Louds(np.array([[x, 0] for p in paths for x in p], np.uint64), np.array([len(p) for p in paths]))
    assert "".join(map(str, t.bits.astype(int))) == "10" + "110" + "110" + "10" + "10" + "0" + "0" + "0"
    assert t.parents.tolist() == [-1, 0, 0, 1, 1, 2, 3] and t.children.tolist() == [2, 2, 1, 1, 0, 0, 0]
    assert [t.find(np.array([[x, 0] for x in p], np.uint64)) for p in paths] == t.ends.tolist() and t.find(np.array([[9, 0]], np.uint64)) == -1
    assert t.roll(np.ones(7, np.int64)).tolist() == [7, 4, 2, 2, 1, 1, 1]
    empty = trie.Louds(np.zeros((0, 2), np.uint64), np.array([0]))
    assert empty.parents.tolist() == [-1] and empty.ends.tolist() == [0]


def test_query_against_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    rel = con.sql(registry.ORACLES["op11_conversation_trie"])
    df = registry.QUERIES["op11_conversation_trie"](spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, df.select(rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
