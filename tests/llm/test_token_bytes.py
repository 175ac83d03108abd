"""Ids for packing against the library, for texts of any kind, and the words that a worker keeps."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import packing
from tidemark.llm.registry import tokenizer_path


def test_ids_as_the_library_gives_them_and_words_kept_between_tasks(monkeypatch):
    rng = random.Random(5)
    odd = ["<|", "<|endoftext|>", "'s", "'LL", "İ", "ŉ", "ª", "日本", "😀", ",", ".", ".", " ", " ", "\n", "The", "12", *map(chr, range(0x250))]
    texts = [None, "", " ", ".", "A,", ".\n,", "x.", "don't. DON'T,"] + ["".join(rng.choices(odd, k=rng.randrange(40))) for _ in range(2000)]
    ids = packing.token_bytes(tokenizer_path())
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in ids.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    plain = [n for n, t in enumerate(texts) if not packing.BEYOND.search(t or "")]
    assert len(plain) > 100
    for kind in (pa.string(), pa.large_string()):
        assert list(ids.every(pa.array(["x", *texts, "y"], kind)[1:-1])) == want
    # by themselves, as a group with an odd text takes another way
    assert list(ids.every(pa.array([texts[n] for n in plain]))) == [want[n] for n in plain]

    class Never:
        def encode_batch_fast(self, *_, **__):
            raise AssertionError("a known word is encoded again")

    later = packing.token_bytes(tokenizer_path())
    monkeypatch.setattr(later, "model", Never())
    assert list(later.every(pa.array(texts))) == want


def test_bounded_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    ids = packing.TokenBytes(tokenizer_path())
    for _ in range(2):
        for text in ("one two, three.", "Two THREE don't", "four, five-five two"):
            assert list(ids.every(pa.array([text, None]))) == [np.array(ids.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), b""]
    assert len(ids.known) < 8
