"""Words of one symbol many times over: equal to the library, in time that grows with their length alone."""

import random
import time

import pytest
import sentencepiece

from tallyweave.llm import piece_codec
from tallyweave.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    return piece_codec.PieceModel(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def seconds(model, text):
    model._forget()
    began = time.perf_counter()
    model.encode([text])
    return time.perf_counter() - began


@pytest.mark.parametrize("unit", [" ", "=", "_", "-", "a", "ab", "▁ ", "\t"])
def test_runs_equal_the_library_in_linear_time(both, unit):
    model, library = both
    for n in (1, 511, 513, 5000, 30_000):
        model._forget()
        assert model.encode([(unit * n)[:n]])[0].tolist() == library.encode((unit * n)[:n])
    short, long_ = (min(seconds(model, (unit * n)[:n]) for _ in range(2)) for n in (30_000, 300_000))
    assert long_ < 40 * max(short, 0.005)  # ten times the length; forty leaves room for a busy machine


def test_mixed_runs_equal_the_library(both):
    model, library = both
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([" a", "  \t=", "-_* ", " abc  ", "the an▁ ", "()[]. ,"])
        text = "".join(rng.choice(letters) * rng.choice([1, 1, 2, 5, 17, 40]) for _ in range(rng.randint(100, 500)))
        model._forget()
        assert model.encode([text])[0].tolist() == library.encode(text)
