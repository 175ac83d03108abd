"""Exact BPE encoding by dynamic programming over prefixes.

The encoding of every prefix of a word has one last token. For each prefix the suffix automaton of the vocabulary
yields the tokens that end there, longest first: it holds the longest part of any token that ends at this place, and its suffix links
lead to the shorter ones. The token that starts at a prefix whose own last token
it is compatible with is the last token of this prefix, and following the starts back gives the encoding. Two tokens
are compatible if BPE, run over their joined text, gives the two again: undoing merges from the later one
on, no merge across the border may come earlier than the merges that formed the sides.

Word ends are symbols of their own here: the last character of a word is shifted, as the vocabulary's
'</w>' tokens are. Words and space-separated chunks are cached up to a bound; texts with characters beyond
Latin, separators that only Python calls white space, or special tokens take the library's normaliser
and word splitter, and the same dynamic programming after that.

Edge cases: null text counts as empty: no token, digests of the empty string; repeated rows are encoded alike;
very long words cost time in proportion to length times the longest token.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

END, SHIFT = "</w>", 0x1000
CHUNKS, WORDS, PAIRS = 500_000, 500_000, 1_000_000  # cached entries a worker
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
BEYOND = regex.compile(r"[^\x00-\x1b\x20-ɏ]|<\|")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Cache(dict):
    """Bounded: once full, further keys are computed each time."""

    def __init__(self, compute, limit: int):
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class SuffixAutomaton:
    """All substrings of the tokens. A token is always the longest string of its state, as nothing stands before it where it was added."""

    def __init__(self, tokens: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [(self._add(t), t) for t in tokens]
        self.token = [-1] * len(self.next)
        for _, t in ends:
            at = 0
            for c in t:
                at = self.next[at][c]
            self.token[at] = tokens[t]
        #: the next state on the suffix links that is a token, 0 for none
        self.shorter = [0] * len(self.next)
        for x in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            y = self.link[x]
            self.shorter[x] = y if self.token[y] >= 0 else self.shorter[y]
        self.longest = [x if t >= 0 else y for x, (t, y) in enumerate(zip(self.token, self.shorter, strict=True))]
        self.move = [m.get for m in self.next]

    def _add(self, token: str) -> int:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in token:
            known = nxt[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            now, p = self._state({}, length[last] + 1), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = now
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[now] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = now
        return last

    def _state(self, moves: dict[str, int], size: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(size)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state for the shorter strings of q."""
        new = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new


class PrefixEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.names = {i: t for t, i in vocab.items()}
        self.library = Tokenizer.from_file(path)
        for t in SPECIAL:
            self.names[self.library.token_to_id(t)] = t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {vocab[a + b]: n + 1 for n, (a, b) in enumerate(pairs)}  # 0: a symbol
        self.halves = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in pairs}
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        self.sound: dict[int, bool] = {}
        symbols = {}
        for t, i in vocab.items():
            if (i in self.halves and self._is_sound(i)) or len(t) == 1 or (len(t) == 5 and t.endswith(END)):
                symbols[self._symbols(t)] = i
        self.tokens = symbols
        self.automaton = SuffixAutomaton(symbols)
        self.bytes = {b: s for b, s in enumerate(byte_symbols())}
        self.fits: dict[int, bool] = {}  # by left << 16 | right
        self.words = _Cache(self._encode_word, WORDS)

    @staticmethod
    def _symbols(token: str) -> str:
        if len(token) > len(END) and token.endswith(END):
            return token[:-5] + chr(ord(token[-5]) + SHIFT)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined text gives just them."""
        if (known := self.fits.get(a << 16 | b)) is None:
            known = self._compatible(a, b)
            if len(self.fits) < PAIRS:
                self.fits[a << 16 | b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right = a, b
        bound = len(self.rank) + 2  # merges from this rank on haven't happened where the border is looked at
        while True:
            m = self.joined.get((left, right))
            if m is not None and self.rank[m] < bound:
                return False
            ra, rb = self.rank.get(left, 0), self.rank.get(right, 0)
            if not ra and not rb:
                return True
            # the later of the two merges is undone; of equals the right one, as BPE merges left to right
            if ra > rb:
                left, bound = self.halves[left][1], ra
            else:
                right, bound = self.halves[right][0], rb + 1

    def _is_sound(self, t: int) -> bool:
        """Whether the token is its own encoding; others can't appear."""
        if (known := self.sound.get(t)) is None:
            known = True
            if t in self.halves:
                a, b = self.halves[t]
                known = self._is_sound(a) and self._is_sound(b) and self._joins(a, b, self.rank[t])
            self.sound[t] = known
        return known

    def _joins(self, a: int, b: int, at: int) -> bool:
        """Whether no merge across the border of a and b comes before merge number at."""
        left, right, bound = a, b, len(self.rank) + 2
        while True:
            m = self.joined.get((left, right))
            if m is not None and self.rank[m] < min(bound, at):
                return False
            ra, rb = self.rank.get(left, 0), self.rank.get(right, 0)
            if not ra and not rb:
                return True
            if ra > rb:
                left, bound = self.halves[left][1], ra
            else:
                right, bound = self.halves[right][0], rb + 1

    def _encode_symbols(self, s: str) -> list[int]:
        last: list[int] = [-1] * (len(s) + 1)
        start = [0] * (len(s) + 1)
        fits, auto = self.fits, self.automaton
        move, link, length, token, shorter, longest = auto.move, auto.link, auto.length, auto.token, auto.shorter, auto.longest
        state = size = e = 0  # the longest part of a token that ends here
        for c in s:
            e += 1
            while (to := move[state](c)) is None and state:
                state = link[state]
                size = length[state]
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            x = longest[state] if length[state] <= size else shorter[state]
            while x:
                t, p = token[x], e - length[x]
                x = shorter[x]
                if p:
                    if (before := last[p]) < 0:
                        continue
                    if (fit := fits.get(before << 16 | t)) is None:
                        fit = self.compatible(before, t)
                    if not fit:
                        continue
                last[e], start[e] = t, p
                break
        out, e = [], len(s)
        while e:
            out.append(last[e])
            e = start[e]
        return out[::-1]

    def _encode_word(self, word: str) -> list[int]:
        s = "".join(map(self.bytes.__getitem__, word.encode()))
        return self._encode_symbols(s[:-1] + chr(ord(s[-1]) + SHIFT))

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a lower-case chunk without white space."""
        return [i for w in WORD.findall(chunk) for i in self.words[w]]

    def plain(self, text: str) -> list[str] | None:
        """Lower-case chunks of the text, or None if it needs rare()."""
        return None if BEYOND.search(text) else text.lower().split()

    def rare(self, text: str) -> list[int]:
        """Ids of any text, by the library's normaliser and word splitter."""
        out: list[int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, SPECIAL)) + ")", text):
            if part in SPECIAL:
                out.append(self.library.token_to_id(part))
            elif part:
                for s, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self._encode_symbols(s[:-1] + chr(ord(s[-1]) + SHIFT))
        return out

    def encode(self, text: str | None) -> list[int]:
        chunks = self.plain(text or "")
        return self.rare(text) if chunks is None else [i for c in chunks for i in self.chunk(c)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)


class QuickEncoder(PrefixEncoder):
    """The same table filled from the matches of an Aho-Corasick automaton, for packing, whose bounds on CPU are narrower; same ids."""

    def __init__(self, path: str):
        super().__init__(path)
        self.matcher = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            self.matcher.add_word(s, (i, len(s)))
        self.matcher.make_automaton()

    def _encode_symbols(self, s: str) -> list[int]:
        last: list[int] = [-1] * (len(s) + 1)
        start = [0] * (len(s) + 1)
        fits = self.fits
        for end, (t, n) in self.matcher.iter(s):
            e = end + 1
            if last[e] < 0:
                p = e - n
                if p:
                    if (before := last[p]) < 0:
                        continue
                    if (fit := fits.get(before << 16 | t)) is None:
                        fit = self.compatible(before, t)
                    if not fit:
                        continue
                last[e], start[e] = t, p
        out, e = [], len(s)
        while e:
            out.append(last[e])
            e = start[e]
        return out[::-1]


_ENCODERS: dict[tuple[type, str], PrefixEncoder] = {}


def encoder(path: str, kind: type[PrefixEncoder] = QuickEncoder) -> PrefixEncoder:
    """One encoder of a kind a worker process."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; a narrow map, no shuffle."""

    def run(batches):
        e = encoder(path, PrefixEncoder)

        def both(chunk):
            ids = e.chunk(chunk)
            return " ".join(map(str, ids)), e.decode(ids)

        cache = _Cache(both, CHUNKS)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                chunks = e.plain(text or "")
                if chunks is None:
                    ids = e.rare(text)
                    i, t = " ".join(map(str, ids)), e.decode(ids)
                else:
                    got = list(map(cache.__getitem__, chunks))
                    i, t = " ".join([g[0] for g in got]), " ".join([g[1] for g in got])
                n.append(i.count(" ") + 1 if i else 0)
                ids_sha.append(hashlib.sha256(i.encode()).hexdigest())
                text_sha.append(hashlib.sha256(t.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
