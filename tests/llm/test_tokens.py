import random
from pathlib import Path

import pytest

from supportlens.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
PATHS = [p for p in (tokens.VOCABULARY,) if Path(p).exists()]
pytestmark = pytest.mark.skipif(not PATHS, reason="no vocabulary here")


@pytest.fixture(scope="module")
def merges():
    return tokens.loaded(Path(tokens.VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding("own", pat_str=tokens.WORDS.pattern, mergeable_ranks=merges.ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    yield from ["", " ", "\n\n  x", "it's we'll we're I'd", "<|endoftext|>", "é́ naïve Straße 👩‍👩‍👧 ​\x00", "   \t\n", "don't  stop ' s", "a" * 5000, "ab" * 3000, " " * 5000 + "x", "=" * 4000, "漢字" * 900, "1234567890" * 400]
    alphabet = "aabcdeéßλ漢😀 '  \n\t.-!?0123sltre"
    for n in (3, 10, 50, 400, 3000):
        for _ in range(20):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(10):
        yield "".join(rng.choice(["the", "ing", "ation", "er", "x", "zq", "un"]) for _ in range(1500))


def test_same_ids_as_the_library_whole_and_in_chunks(merges, library):
    rng = random.Random(7)
    for text in texts():
        want = library.encode_ordinary(text)
        assert tokens.encode(merges, text) == want, text[:60]
        encoder, got, i = tokens.Encoder(merges), [], 0
        while i < len(text):
            n = rng.choice([1, 2, 3, 7, 100, 2500])
            got += encoder.feed(text[i : i + n])
            i += n
        assert got + encoder.finish() == want, text[:60]


def test_memory_held_back_is_bounded(merges):
    encoder = tokens.Encoder(merges)
    out = 0
    for _ in range(300):
        out += len(encoder.feed("abcab" * 40))
        held = len(encoder.held) + (len(encoder.run[1].tail) if encoder.run else 0)
        assert held < tokens._LONG_WORD + 5 * merges.lookahead + 300
    assert out


def test_decode_round_trip(merges):
    for text in texts():
        assert tokens.decode(merges, tokens.encode(merges, text)) == text


def test_null_and_empty(merges):
    assert tokens.encode(merges, None) == tokens.encode(merges, "") == []
