"""Exact encoding with a SentencePiece model of the BPE kind, by a table of prefixes.

Two neighbours merge where their joined text is a piece, best score first, ties from the left. The order of merges in one part
of a text doesn't depend on the rest, so tokens t1..tn are the encoding if and only if the merges over the text of each pair of
neighbours give that pair again. Hence each prefix has one last token: of the pieces that end there (an automaton over all
pieces yields them), the one whose start is a prefix with a last token that it is compatible with. The table keeps this token
and its start; following the starts back from the end gives the ids.

Spaces and the mark U+2581 are one symbol, and a text that isn't empty gets one in front. A piece never holds this symbol behind
another one, nor certain signs behind a letter, nor a character outside the model's alphabet; texts are cut there and the parts
cached up to a bound. Characters outside the alphabet become the pieces of their bytes.

Edge cases: null text counts as empty: no id, digests of the empty string; repeated rows are encoded alike; runs of spaces and
words of any length cost time in proportion to their length times the longest piece.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

MARK = "▁"
PARTS, PAIRS, LONGEST = 500_000, 1_000_000, 64  # cached parts and pairs a worker; characters of a part that is cached

#: Each byte that is part of no character becomes a replacement character of its own.
codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceEncoder:
    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in every if model.is_byte(i)}
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names = {i: model.id_to_piece(i).replace(MARK, " ") for i in plain}
        self.ids = {name: i for i, name in self.names.items()}
        self.score = {name: model.get_score(i) for name, i in self.ids.items()}
        self.values = {i: b for b, i in self.bytes.items()}
        alphabet = {c for name in self.ids for c in name}
        self._check(model, alphabet)
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        signs = {c for c in alphabet if not (c.isalpha() or c.isdecimal())} - {" "}  # those that no piece holds behind a character that isn't one
        while late := {b for name in self.ids for a, b in zip(name, name[1:]) if b in signs and a not in signs and a != " "}:
            signs -= late
        some, known = ("".join(re.escape(c) for c in sorted(x)) for x in (signs, alphabet - signs - {" "}))
        self.parts = re.compile(f" *[{some}]*+[{known}]+| *[{some}]+| +|[^ {some}{known}]+")
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, str, str]] = {}

    def _check(self, model: SentencePieceProcessor, alphabet: set[str]) -> None:
        """The model must be of the kind that this module encodes."""
        if len(self.bytes) != 256 or not alphabet <= self.ids.keys():
            raise ValueError("a model with byte pieces and a piece for each of its characters is needed")
        if any(re.search("[^ ] ", name) for name in self.ids) or model.normalize(" a  ▁ﬁ") != f"{MARK}{MARK}a{MARK}{MARK}{MARK}ﬁ":
            raise ValueError("a model that keeps texts as they are and cuts before spaces is needed")

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best pair first, ties from the left."""
        parts = list(text)
        while True:
            best = min(((-self.score[m], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two pieces are the encoding of their joined text."""
        if (known := self.fits.get((a, b))) is None:
            known = self.merge(a + b) == [a, b]
            if len(self.fits) < PAIRS:
                self.fits[a, b] = known
        return known

    def _pieces(self, part: str) -> list[str]:
        """Pieces of a text inside the alphabet, from the table of its prefixes."""
        last: list[str | None] = [None] * (len(part) + 1)
        for end, piece in self.automaton.iter(part):  # ends in ascending order, longer pieces first
            e = end + 1
            if last[e] is None:
                p = e - len(piece)
                if (before := last[p]) is not None and self.compatible(before, piece) or p == 0 and self._whole(piece):
                    last[e] = piece
        out, e = [], len(part)
        while e:
            out.append(last[e])
            e -= len(last[e])
        return out[::-1]

    def _whole(self, piece: str) -> bool:
        """Whether the piece is its own encoding."""
        if (known := self.fits.get(("", piece))) is None:
            self.fits["", piece] = known = self.merge(piece) == [piece]
        return known

    def _encode_part(self, part: str) -> list[int]:
        if part[-1] in self.ids:
            return [self.ids[p] for p in self._pieces(part)]
        return [self.bytes[b] for b in part.encode()]

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self._split(text) for i in self._encode_part(part)]

    def _split(self, text: str | None) -> list[str]:
        return self.parts.findall(" " + text.replace(MARK, " ")) if text else []

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids, the symbol in front included."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.values:
                run.append(self.values[i])
                continue
            if run:
                out.append(run.decode(errors="each byte"))
                run.clear()
            out.append(self.names[i])
        return "".join(out) + run.decode(errors="each byte")

    def decode(self, ids: Iterable[int]) -> str:
        return self.surface(ids).removeprefix(" ")

    def outcome(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text."""
        got, cache = [], self.cache
        for part in self._split(text):
            if (one := cache.get(part)) is None:
                ids = self._encode_part(part)
                one = len(ids), ",".join(map(str, ids)), self.surface(ids)
                if len(part) <= LONGEST and len(cache) < PARTS:
                    cache[part] = one
            got.append(one)
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), "".join([g[2] for g in got]).removeprefix(" ")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; a narrow map, no shuffle."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        e = encoder(path)
        for b in batches:
            n, ids, texts = [], [], []
            for text in b.column(1):
                count, joined, decoded = e.outcome(text.as_py())
                n.append(count)
                ids.append(sha(joined))
                texts.append(sha(decoded))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
