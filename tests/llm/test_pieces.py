"""The table of prefixes against the library and against merging by definition."""

import hashlib
import random

import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.registry import tokenizer_path
from tests.llm.test_operators import by_id, corpus, table

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PATH)


def sayings():
    rng = random.Random(5)
    yield from ["", " ", "  a  b ", "\ta\nb\r\n", "a▁b", "▁▁a", "\x00x", "漢字😀👩‍👩‍👧", "<s>x</s><unk>", "<0x41>", "a\xa0b", "�", "m².", "é́", " " * 1000 + "x", "a" * 3000, "  " * 40]
    for alphabet in (" ▁abeinrst\n漢é=-", "ab ", "=-_/* #.", "aA1²., "):
        for _ in range(500):
            yield "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(1, 60)))


def test_as_the_library(encoder, library):
    rng = random.Random(6)
    names = list(encoder.ids)
    texts = [*sayings(), *("".join(rng.choice(names) for _ in range(rng.randint(1, 30))) for _ in range(3000))]
    for t in texts:
        want = library.encode(t)
        assert encoder.encode(t) == want, t
        assert encoder.decode(want) == library.decode(want)
        assert encoder.outcome(t) == (len(want), ",".join(map(str, want)), library.decode(want))


def test_merging_by_definition(encoder):
    rng = random.Random(7)
    for _ in range(500):
        part = " " * rng.randint(0, 5) + "".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 25)))
        assert encoder._pieces(part) == encoder.merge(part)


def test_bytes_that_are_no_text(encoder, library):
    for ids in ([233, 191], [100, 233, 191, 165, 3], [259, 200, 28705]):
        assert encoder.decode(ids) == library.decode(ids)


def test_query_columns(spark, library):
    texts = corpus()
    docs = table(spark, texts)
    got = by_id(pieces.digests(docs.union(docs.where("doc_id < 2")), PATH))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert pieces.digests(docs.limit(0), PATH).count() == 0


def test_other_models_are_refused(monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(pieces, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        pieces.PieceEncoder(PATH)
