"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to islands by a hash of their place in the checkpointed
table, so no document, source or group of copies can fill one; an island holds a bounded number and a task one island. On each island individuals are
groupings of the pieces into bins. Crossover injects well-filled bins of one parent into the other whole,
removes the bins that hold the same pieces, and best-fits the displaced ones; mutation does so with the worst
bins. After the first epoch the islands hand their elite bins on as size patterns to the next island of a ring,
which fills those patterns with pieces of its own. Pieces of full length take a bin each and no part.

Edge cases: null text is the separator token alone; repeated rows are packed each; an empty table gives an
empty result; texts of any length are cut into full pieces and a rest.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .anchors import sliced
from .bpe import BEYOND, END, WORD
from .io import released

CAPACITY = 2048
WORDS = 200_000  # kept by a worker, about
ISLAND = 8192  # pieces an island holds, about
POPULATION, ELITES = 10, 48
EFFORT = 200_000  # pieces times generations of an island; 24 generations of a full one, GENERATIONS of a small one
GENERATIONS, PAIRS, FEW = 400, 48, 12  # the most generations; displaced pieces, and pieces of a bin, up to which they are also tried in pairs
SEPARATOR = (0).to_bytes(4, "little")
#: by byte: its lower case, whether it is a letter then, white space, or may begin a character that BEYOND finds
LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], dtype=np.uint8)
LETTER = np.array([chr(b).islower() and b < 128 for b in range(256)])
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
ODD = np.array([b >= 0xC9 or 0x1C <= b < 0x20 for b in range(256)])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of large strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return offsets - offsets[0], np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]


def loosened(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space between a letter and a comma or stop that ends a chunk; their words stay."""
    offsets, data = raw(texts)
    data = LOWER[data]
    end = ((data == ord(",")) | (data == ord("."))).nonzero()[0]
    end = end[(end > 0) & (end < len(data) - 1)]
    end = end[LETTER[data[end - 1]] & SPACE[data[end + 1]]]
    data = np.insert(data, end, ord(" "))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets + np.searchsorted(end, offsets)), pa.py_buffer(data)])


class TokenBytes:
    """Ids as little-endian bytes, by the tokenizers library; it sees each uncached word once a group of texts."""

    GROUP = 2 << 20  # bytes of a group of texts, about
    JOINED = 256  # words in one call of the library

    def __init__(self, path: str):
        self.library, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words that are cut and in lower case already
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.known: dict[str, bytes] = {}  # of words, and of chunks of several

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        """Words of the splitter stay apart when joined by spaces, and each ends with one end-of-word token."""
        out: dict[str, bytes] = {}
        for lo in range(0, len(words), self.JOINED):
            part = words[lo : lo + self.JOINED]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, cut = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out.update(zip(part, [data[a:z] for a, z in zip([0, *cut], cut)], strict=True))
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Bytes of each of some distinct chunks without white space."""
        known = self.known
        found = list(map(known.get, chunks))
        missing = [k for k, b in enumerate(found) if b is None]
        split = {k: WORD.findall(c.lower()) for k in missing if not ((c := chunks[k]).isalpha() and c.islower() and c.isascii())}
        words = {chunks[k] for k in missing if k not in split}
        words.update(w for own in split.values() for w in own if w not in known)
        new = self._new_words(list(words))
        for k, own in split.items():
            found[k] = new[chunks[k]] = b"".join([known[w] if w in known else new[w] for w in own])
        for k in missing:
            if found[k] is None:
                found[k] = new[chunks[k]]
        if len(known) < WORDS:
            known.update(new)
        return found

    def every(self, texts: pa.Array):
        """Bytes of each text, in order."""
        for group in sliced([pa.record_batch([texts], ["text"])], 0, self.GROUP):
            yield from self._group(pc.fill_null(group.column(0), "").cast(pa.large_string()))

    def _group(self, texts: pa.Array):
        rare = self._rare(texts)
        if rare:
            mask = np.zeros(len(texts), dtype=bool)
            mask[list(rare)] = True
            texts = pc.if_else(pa.array(mask), "", texts).cast(pa.large_string())
        split = pc.utf8_split_whitespace(loosened(texts))
        chunks = split.flatten().dictionary_encode()
        found = pa.array(self._chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        offsets, data = raw(found)
        at, data = offsets[split.offsets.to_numpy()].tolist(), memoryview(data)
        for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)):
            yield rare[k] if k in rare else bytes(data[a:z])

    def _rare(self, texts: pa.Array) -> dict[int, bytes]:
        """Bytes, by row, of the texts that must be cut by the library; most groups are told to have none by their bytes alone."""
        _, data = raw(texts)
        if not (ODD[data].any() or ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any()):
            return {}
        return {k: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for k, t in enumerate(texts.to_pylist()) if BEYOND.search(t)}


_TOKENS: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    """One a worker process, which keeps its words from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = TokenBytes(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, without their ids; a narrow map."""

    def run(batches):
        ids_of = token_bytes(path)
        step = 4 * capacity
        for b in batches:
            rows, at = [], []
            for k, ids in enumerate(ids_of.every(b.column(1))):
                ids += SEPARATOR
                for p, s in enumerate(range(0, len(ids), step)):
                    part = ids[s : s + step]
                    rows.append((p, s // 4, len(part) // 4, zlib.crc32(part)))
                    at.append(k)
            if rows:
                cols = [b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), PIECES)


class Island:
    """Groupings of the pieces with the given sizes; an individual is a list of bins, a bin a list of piece numbers."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)

    def fill(self, b: list[int]) -> int:
        return sum(self.sizes[i] for i in b)

    def best_fit(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """bins with the loose pieces put, largest first, where the least room is left."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for k, b in enumerate(bins):
            r = self.capacity - self.fill(b)
            room[r].append(k)
            mask |= 1 << r
        for i in sorted(loose, key=self.sizes.__getitem__, reverse=True):
            s = self.sizes[i]
            if fits := mask >> s:
                r = s + (fits & -fits).bit_length() - 1
                k = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
            else:
                k, r = len(bins), self.capacity
                bins.append([])
            bins[k].append(i)
            r -= s
            if not room[r]:
                mask |= 1 << r
            room[r].append(k)
        return bins

    def score(self, bins: list[list[int]]) -> tuple[int, int]:
        """Fewest bins first, then the most uneven filling, which leaves the most room in one place."""
        return -len(bins), sum(self.fill(b) ** 2 for b in bins)

    def exchange(self, bins: list[list[int]], loose: list[int]) -> list[int]:
        """Swaps one or two pieces of a bin for one or two loose ones that fill it better; gives what is loose then."""
        order = list(range(len(bins)))
        self.rng.shuffle(order)
        size = self.sizes.__getitem__

        paired = len(loose) <= PAIRS
        on_offer = [(size(i), (i,)) for i in loose]
        if paired:
            on_offer += [(size(i) + size(j), (i, j)) for i, j in combinations(loose, 2)]
        on_offer.sort()
        keys = [o[0] for o in on_offer]
        for k in order:
            b = bins[k]
            room = self.capacity - self.fill(b)
            if not room or not on_offer:
                continue
            best, swap = 0, None
            for out in [(), *((i,) for i in b), *(combinations(b, 2) if len(b) <= FEW else ())]:
                gone = sum(map(size, out))
                at = bisect_right(keys, gone + room) - 1
                if at >= 0 and keys[at] - gone > best:
                    best, swap = keys[at] - gone, (out, on_offer[at][1])
            if swap:
                out, put = set(swap[0]), set(swap[1])
                bins[k] = [i for i in b if i not in out] + list(put)
                left = [i for i in loose if i not in put]
                on_offer = [o for o in on_offer if put.isdisjoint(o[1])] + [(size(i), (i,)) for i in out]
                if paired:
                    on_offer += [(size(i) + size(j), (i, j)) for i in out for j in left] + [(size(i) + size(j), (i, j)) for i, j in combinations(out, 2)]
                on_offer.sort()  # in order but for the new ones
                keys = [o[0] for o in on_offer]
                loose = left + list(out)
        return loose

    def injected(self, into: list[list[int]], good: list[list[int]]) -> list[list[int]]:
        """Bins of into with good ones put in whole: bins that share a piece go, and their other pieces are fitted anew."""
        taken = {i for b in good for i in b}
        out, loose = [], []
        for b in into:
            if taken.isdisjoint(b):
                out.append(list(b))
            else:
                loose += [i for i in b if i not in taken]
        return self.refitted([list(b) for b in good] + out, loose)

    def refitted(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        return self.best_fit(bins, self.exchange(bins, loose) if len(loose) <= 4 * PAIRS else loose)

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """a with some of the best-filled bins of b that a doesn't have."""
        own = {frozenset(x) for x in a}
        full = [x for x in b if self.fill(x) >= self.capacity - 2 and frozenset(x) not in own]
        return self.injected(a, self.rng.sample(full, self.rng.randint(1, max(1, min(len(full), 1 + len(a) // 10)))) if full else [])

    def mutate(self, a: list[list[int]]) -> list[list[int]]:
        """a with some of the emptiest bins and some others taken apart."""
        order = sorted(range(len(a)), key=lambda k: self.fill(a[k]))
        few = self.rng.randint(2, max(3, min(12, len(a) // 4)))
        drop = set(order[: few // 2]) | set(self.rng.sample(range(len(a)), min(len(a), few)))
        loose = [i for k in drop for i in a[k]]
        self.rng.shuffle(loose)
        return self.refitted([list(b) for k, b in enumerate(a) if k not in drop], loose)

    def patterns(self, patterns: list[list[int]]) -> list[list[int]]:
        """Bins of own pieces that repeat the given size patterns, each as often as there are pieces for it."""
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.sizes):
            by.setdefault(s, []).append(i)
        out = []
        for p in patterns:
            got = []
            for s in p:
                if not by.get(s):
                    break
                got.append(by[s].pop())
            if len(got) == len(p):
                out.append(got)
            else:
                for i in got:
                    by[self.sizes[i]].append(i)
        return out

    def evolve(self, start: list[list[int]] | None, elites: list[list[int]]) -> list[list[int]]:
        every = list(range(len(self.sizes)))
        first = start if start is not None else self.best_fit([], every)
        floor = -(-sum(self.sizes) // self.capacity)
        pop = [(self.score(first), first)]  # individuals with their scores, which are counted once

        def join(new: list[list[int]]) -> None:
            score = self.score(new)
            if all(own != score for own, _ in pop):
                pop.append((score, new))

        if start is not None and len(first) > floor:
            join(self.injected(first, self.patterns(elites)))
        for _ in range(POPULATION):
            if min(len(p) for _, p in pop) > floor:  # none reaches the bound yet
                join(self.mutate(first))
        for _ in range(min(GENERATIONS, EFFORT // max(1, len(self.sizes)))):
            pop.sort(key=lambda p: p[0], reverse=True)
            del pop[POPULATION:]
            if len(pop[0][1]) <= floor or len(pop) < 2:
                break
            a, b = (min(self.rng.sample(range(len(pop)), 2)) for _ in range(2))  # the better of two, twice
            child = self.cross(pop[a][1], pop[b][1]) if a != b else self.mutate(pop[a][1])
            join(child)
            if len(child) > floor:
                join(self.mutate(child))
        return max(pop, key=lambda p: p[0])[1]


PACKED = "island int, " + PIECES + ", bin int"


def _epoch(dealt: DataFrame, islands: int, capacity: int, epoch: int) -> DataFrame:
    """Rows of dealt (island, the piece, bin, elites) with new bins. An island's rows are its bounded share."""

    def island_run(key: int, t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        sizes = t.column("length").to_pylist()
        bins = np.full(len(sizes), -1)
        small = [k for k, s in enumerate(sizes) if s < capacity]
        rest = Island([sizes[k] for k in small], capacity, 7919 * key + epoch)
        start, elites = None, []
        if epoch:
            old: dict[int, list[int]] = {}
            known = t.column("bin").to_pylist()
            for n, k in enumerate(small):
                old.setdefault(known[k], []).append(n)
            start = list(old.values())
            elites = next((e for e in t.column("elites").to_pylist() if e), [])
        found = rest.evolve(start, elites) if small else []
        for n, b in enumerate(found):
            for i in b:
                bins[small[i]] = n
        full = np.flatnonzero(bins < 0)
        bins[full] = len(found) + np.arange(len(full))
        t = t.select(["island", "doc_id", "piece", "start", "length", "ids_crc32"]).append_column("bin", pa.array(bins, pa.int32()))
        return t.combine_chunks().to_batches()[0]

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:  # sorted by island: one is held at a time
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                k = int(keys[s])
                if k not in held and held:
                    (done, parts), held = next(iter(held.items())), {}
                    yield island_run(done, pa.Table.from_batches(parts))
                held.setdefault(k, []).append(b.slice(s, e - s))
        for done, parts in held.items():
            yield island_run(done, pa.Table.from_batches(parts))

    return dealt.repartitionById(islands, F.col("island")).sortWithinPartitions("island").mapInArrow(released(run), PACKED)


def _elites(packed: DataFrame, islands: int, capacity: int) -> DataFrame:
    """Size patterns of some of the best-filled bins of each island, addressed to the next island; ELITES rows an island at most."""
    bins = packed.where(F.col("length") < capacity).groupBy("island", "bin").agg(F.sum("length").alias("filled"), F.sort_array(F.collect_list("length"), asc=False).alias("sizes"))
    good = bins.where(F.col("filled") >= capacity - 1).groupBy("island").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.size("sizes").alias("n"), F.col("bin"), F.col("sizes")))), 1, ELITES).alias("e"))
    return good.select(F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.transform("e", lambda x: x["sizes"]).alias("elites"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there. Pieces are checkpointed, so texts are tokenized once."""
    cut = pieces(docs, path, capacity).checkpoint()
    islands = max(1, -(-cut.count() // ISLAND))
    dealt = cut.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(islands)).cast("int").alias("island"), "*")
    none = F.lit(None).cast("int").alias("bin"), F.lit(None).cast("array<array<bigint>>").alias("elites")
    now = _epoch(dealt.select("*", *none), islands, capacity, 0)
    if islands > 1:
        now = now.checkpoint()
        first = now.where(F.col("bin") == 0).groupBy("island").agg(F.min(F.struct("doc_id", "piece", "start", "ids_crc32")).alias("_f"))
        told = first.join(_elites(now, islands, capacity), "island").select(F.col("island").alias("_i"), "elites", "_f")
        # the patterns ride on one row of their island
        same = F.col("island") == F.col("_i")
        for c in ("doc_id", "piece", "start", "ids_crc32"):
            same = same & F.col(c).eqNullSafe(F.col(f"_f.{c}"))
        now = _epoch(now.join(told, same, "left").drop("_i", "_f"), islands, capacity, 1)
    return _places(now, islands)


def _places(packed: DataFrame, islands: int) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("sequence_id").orderBy("doc_id", "piece", "start", "ids_crc32", "length").rowsBetween(W.unboundedPreceding, -1)
    numbered = packed.withColumn("sequence_id", F.col("island").cast("long") * F.lit(1 << 32) + F.col("bin"))
    return numbered.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
