"""Token counts of long and odd texts."""

import random
import time

import pytest

from millrace.llm import token_counts


@pytest.fixture(scope="module")
def enc():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts._encoder(f.read())


def test_long_runs_have_the_uncut_tokens(enc):
    rng = random.Random(1)
    spaces = [" ", "\n", "\t", "　", "\xa0", "\r\n", " \n "]
    for _ in range(40):
        text = ""
        for _ in range(rng.randint(1, 6)):
            text += rng.choice(["", "word", "don't", "12", "é漢", "!?", "\x1c"]) + rng.choice(spaces) * rng.choice([0, 1, 3, 4095, 4096, 5000, 9001])
        text += rng.choice(["", "end", "\x1f", "7"])
        assert token_counts.encode(enc, text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [63, 64, 65, 250, 1000, 4000])
@pytest.mark.parametrize("space", [" ", "\n", "\t ", "\u3000"])
def test_runs_of_any_length_take_linear_time(enc, run, space):
    text = "".join(f"word{i}{space * run}" for i in range(400_000 // (run * len(space)) + 1))
    start = time.perf_counter()
    ids = token_counts.encode(enc, text)
    assert time.perf_counter() - start < 1.0 * max(0.4, len(text.encode()) / 1e6)
    short = text[:20_000]
    assert enc.decode(ids) == text and token_counts.encode(enc, short) == enc.encode_ordinary(short)


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" + " " * 5_000_000 + "b", "\n" * 3_000_000 + " x", "ab" * 1_000_000, "漢字" * 500_000, "12" * 500_000, "?!" * 500_000], ids=range(7))
def test_texts_of_millions(enc, text):
    ids = token_counts.encode(enc, text)
    assert enc.decode(ids) == text


def test_long_texts_pass_the_query(spark):
    rows = [(1, " " * 1_500_000 + "x"), (2, "a b"), (None, "漢" * 300_000)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, None} and got[2] == 2 and got[1] >= 2
