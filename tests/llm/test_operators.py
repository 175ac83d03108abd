"""Every operator against brute force on small tables with nulls, blanks, ties, repeated rows and clashing extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, license_scan, packing, qda, quality_rules, registry, simhash, substring, suffix_dedup, toxicity, vptree
from tidemark.llm.anchors import BYTES, WORDS, byte_values, rolled, segments, sliding_min, word_values
from tidemark.llm.components import stars

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, island int"
SPACE = rb"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = say(60), say(900)
    texts = [say(rng.randint(1, 120)) for _ in range(60)]
    texts += [long, long, long.replace(" ", "  ", 3), say(30) + "\n" + passage + "\n" + say(12), passage, say(15) + " " + passage]
    texts += [None, "", " \t\n", "one", "one two", "MIT License", "the Mit-license and GNU General Public License, version 3\nApache  license", "ΣΑΣ 漢字 😀 <|endoftext|> x\x1cy"]
    texts += ["a b c d e " * 40, "#### $$$$ " * 20, "same line\nsame line\n\nsame line", say(5) + " x" * 300, "licensed under the Apache License, version 2.0"]
    texts += [w + " " + say(25) for w in ["idiot", "1diot"] for _ in range(8)]
    texts += [passage.replace(passage.split()[30], "changed", 1), passage + "."]
    return texts


def table(spark, texts, first=0):
    rows = [(first + i, t, ["en", "fr", None][i % 3], "s", 0, "clash", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    d = table(spark, texts)
    return d.union(d.where("doc_id in (3, 60)"))  # repeated rows


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 5 and 1, int("diot" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r  # repeated rows share an outcome
    return out


def test_quality_counts(docs, labels, texts):
    got = by_id(quality_rules.assess(docs, labels))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        where = {}
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5]), []).append(k)
        under = {j for v in where.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(under))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(under) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_binomial_tail(spark):
    from math import comb, log

    for n, k, p in ((50, 0, 0.1), (50, 7, 0.1), (400, 30, 0.05)):
        want = log(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
        got = spark.range(1).select(quality_rules.binomial_tail_log(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_thresholds_keep_the_risk(spark):
    rows = [(i, "en", 100, 500, 90 if i % 10 == 0 else 0, 0, 0, 5, 10) for i in range(20000)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    labels = measured.select("doc_id", (F.col("n_symbols") == 0).cast("int").alias("quality"))
    cuts = quality_rules.thresholds(measured, labels).collect()
    assert {r["_stratum"]: set(r["_cut"]) for r in cuts} == {"en": {"symbols_per_word"}}
    few = quality_rules.thresholds(measured.limit(50), labels).collect()
    assert few == []


def test_license_base(docs, texts):
    got = by_id(license_scan.scan(docs))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, v) for k in range(len(w)) for p, v in phrases.items() if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    notice = next(r for i, r in got.items() if (texts[i] or "").startswith("licensed under"))
    assert "apache-2.0" in notice.labels


def test_license_containment(spark):
    d = table(spark, ["under the GNU Lesser General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy"])
    got = by_id(license_scan.scan(d))
    assert got[0].labels == "gpl,lgpl"  # the base label stays
    assert got[1].labels == "mit" and got[1].score == 1.0


def brute_words(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(k)
        kept = [x for x, f in zip(w, keep) if f]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring(docs, texts):
    got = by_id(substring.digests(docs))
    want = brute_words(texts)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert sum(n for _, n, _ in want.values()) > 900


def test_substring_keeps_columns(docs):
    packed = docs.select("doc_id", "text", F.struct("n_words").alias("_rest"))
    out = substring.remove(packed)
    assert out.columns[:3] == packed.columns and out.where("doc_id = 66").first()["text"] is None


def test_automaton():
    a = substring.SuffixAutomaton()
    a.add("abcab")
    a.add("bcda")
    assert list(a.matching("xabcdab")) == [0, 1, 2, 3, 3, 4, 2]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    a, strings = substring.SuffixAutomaton(), ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(4)]
    for s in strings:
        a.add(s)
    q = "".join(rng.choice("abc") for _ in range(15))
    want = [max(n for n in range(e + 1) if any(q[e - n : e] in s for s in strings)) for e in range(1, len(q) + 1)]
    assert list(a.matching(q)) == want


def test_suffix_dedup(docs, texts):
    got = by_id(suffix_dedup.digests(docs))
    blobs = [(t or "").encode() for t in texts]
    n = {}
    for b in blobs:
        for s in range(len(b) - 399):
            n[b[s : s + 400]] = n.get(b[s : s + 400], 0) + 1
    for i, b in enumerate(blobs):
        keep = np.ones(len(b), dtype=bool)
        for s in range(len(b) - 399):
            if n[b[s : s + 400]] > 1:
                keep[s : s + 400] = False
        spans = int((~keep & np.r_[True, keep[:-1]]).sum()) if len(b) else 0
        want = (len(b), int((~keep).sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want


def test_anchor_parts():
    v = word_values([b"%d" % (k * k % 91) for k in range(300)])
    h = rolled(v, 13)
    assert len(h) == 288 and len(set(h[[0, 1]])) == 2 and h[5] == rolled(v[5:18], 13)[0]
    assert list(sliding_min(v, 7)) == [min(v[i : i + 7]) for i in range(294)]
    s = segments(WORDS, v, np.array([100, 110, 300]))
    windows = [(d, a) for d, a, z, _, _ in s.tolist() for a in range(a, z + 1)]
    assert windows == [(0, a) for a in range(81)] + [(2, a) for a in range(110, 281)]
    assert len(byte_values(b"abc")) == 3 and BYTES.cut(b"abcdef", 1, 3) == b"bc"


def brute_print(t):
    w = re.findall(SPACE, (t or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    got = by_id(simhash.near_duplicates(docs))
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in range(len(texts))}


def test_forest_links_across_both_searches(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    v = np.unique(np.concatenate([base] + [b ^ np.uint64(1 << k) ^ np.uint64(1 << j) for b in base for k in range(0, 60, 7) for j in range(1, 60, 9)], axis=None))

    def groups():
        e = simhash.forest(v)
        return len(v) - len(e), {r for _, r in e}

    compared = groups()
    monkeypatch.setattr(simhash, "PROBE", 1)
    assert groups() == compared and compared[0] == 3


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1, 1), (3, 4), (3, 4)] + [(500, k) for k in range(300, 340)]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: r for k, r in root.items() if k != r}
    assert stars(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8))
    x[5] = x[6] = x[7] = x[8] = x[9] = x[10] = x[11] = x[50]
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(x)]
    rows += [(700, None, 0), (701, [0.0] * 8, 0), (702, [None] + [1.0] * 7, 0), (703, [float("nan")] * 8, 0), (704, [float("inf")] + [1.0] * 7, 0), (750, [1.0, 2.0], 0)]
    return x, spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>, label int")


def test_search_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 16)
    x, df = vectors(spark)
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 700, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        order = np.lexsort((np.arange(700), -s))[:5]
        assert [v for _, v, _ in sorted(got[q])] == list(order)
        assert np.allclose([c for _, _, c in sorted(got[q])], s[order])
    assert set(got) == set(range(0, 700, 50))  # the one vector of two parts finds none


def test_relaxed_search_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 8))
    tree = vptree.VPTree(x)
    exact = tree.search(x[:60], 6)[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {frozenset(r) for r in exact} == {frozenset(np.argsort(-(unit @ unit[i]))[:6]) for i in range(60)}
    loose = tree.search(x[:60], 6, factor=1.2)[1]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(exact, loose)]) >= 0.9


def test_bpe_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    t = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, r in by_id(bpe.digests(docs, path)).items():
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_on_random_text():
    e = bpe.encoder(registry.tokenizer_path())
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'ÀéßIİΣσς012²Ⅷ ,.!?\n\t\x1c\x85 漢字😀<|>"
    parts = ["the", "don't", "we'll", "<|endoftext|>", "naïve", "antidisestablishmentarianism", "...", "ing"]
    for _ in range(3000):
        x = "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert e.encode(x) == e.library.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("island", [25, 8192])
def test_packing(docs, texts, island, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ISLAND", island)
    path = registry.tokenizer_path()
    rows = packing.pack(docs, path, capacity=256).collect()
    t, want = Tokenizer.from_file(path), []
    for r in docs.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(r["doc_id"], p, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 256
    bound = -(-sum(w[3] for w in want) // 256)
    assert len(bins) <= bound + 2 * -(-len(want) // island) + 2


def test_toxicity_learns_subwords():
    rng = random.Random(0)
    say = lambda: [rng.choice(["house", "tree", "river", "cloud", "stone", "wind"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(40)]
    texts, classes = [], []
    for k in range(300):
        w = say()
        if k % 2:
            w[rng.randrange(40)] = "grumble" + rng.choice(["r", "d", "some"])
        texts.append(" ".join(w))
        classes.append(k % 2)
    scores = toxicity._scorer(toxicity.train(texts, classes))
    s = scores(["a house of grumbleth by the tree", "a house of stones by the tree", None])
    assert s[0] > 0.7 > s[1] and 0 <= s[2] <= 1


def test_toxicity_and_quality_over_odd_rows(docs, labels, texts):
    for got, folds, held in ((by_id(toxicity.assess(docs, labels)), 3, 1), (by_id(qda.assess(docs, labels)), 5, 0)):
        for i, r in got.items():
            assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r.score <= 1
    assert set(got) == set(range(len(texts)))


def test_discriminant_separates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 3, (300, 12)), rng.normal(1, 0.3, (300, 12))])
    y = np.repeat([0, 1], 300)
    assert ((qda.Discriminant(x, y).score(x) >= 0.5) == y).mean() > 0.98
    assert set(qda.Discriminant(x[:300], y[:300]).score(x)) == {0.5}


def test_empty_tables(spark, labels):
    d = table(spark, []).limit(0)
    path = registry.tokenizer_path()
    none = labels.limit(0)
    for out in (quality_rules.assess(d, labels), license_scan.scan(d), substring.digests(d), suffix_dedup.digests(d), simhash.near_duplicates(d), toxicity.assess(d, none), qda.assess(d, none), bpe.digests(d, path), packing.pack(d, path)):
        assert out.collect() == []
    assert vptree.nearest(vectors(spark)[1].limit(0), F.lit(True)).collect() == []


def test_suffix_automaton_finds_all_tokens():
    """Tokens that end at each place, longest first, against trying all substrings."""
    rng = random.Random(12)
    for _ in range(60):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): i for i in range(rng.randint(1, 25))}
        auto = bpe.SuffixAutomaton(tokens)
        text = "".join(rng.choice("abcd") for _ in range(60))
        state = size = 0
        for e, c in enumerate(text, 1):
            while c not in auto.next[state] and state:
                state = auto.link[state]
                size = auto.length[state]
            state, size = (auto.next[state][c], size + 1) if c in auto.next[state] else (0, 0)
            x, got = state if auto.token[state] >= 0 and auto.length[state] <= size else auto.shorter[state], []
            while x:
                got.append(auto.token[x])
                x = auto.shorter[x]
            assert got == [tokens[text[k:e]] for k in range(e) if text[k:e] in tokens]


def test_both_encoders_agree():
    rng = random.Random(13)
    a, b = (kind(registry.tokenizer_path()) for kind in (bpe.PrefixEncoder, bpe.QuickEncoder))
    for _ in range(3000):
        t = "".join(rng.choice("abcdefghiklmnorstué'ß漢 0.") for _ in range(rng.randint(0, 40)))
        assert a.encode(t) == b.encode(t) == a.library.encode(t, add_special_tokens=False).ids
