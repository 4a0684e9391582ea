"""Ids by pieces equal the tokenizers library's own ids."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    from textloom.llm.tokens import PieceEncoder

    path = P.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), PieceEncoder(path, capacity=500)


def test_matches_library_on_random_texts(pair):
    whole, pieces = pair
    rnd = random.Random(1)
    parts = ["the", "Énd", "don't", " ", "  ", "\n", "\n\n", " \n ", "\t", "\x1c", "\x85", " ", "　", "12", "x1", ".", "!!", "'s", "<|endoftext|>", "日本", "🙂", "a" * 70, "\r\n", "#$%", "it's", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14))) for _ in range(3000)] + [" ".join(rnd.choice(parts) for _ in range(8)) for _ in range(1000)] + ["", " ", "\n", None]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, octets in zip(some, pieces.encode_many(some), strict=True):
            assert np.frombuffer(octets, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
