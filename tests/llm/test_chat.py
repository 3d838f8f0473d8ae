"""Chat formatting: repeats, crowds of rows without turn numbers, whole transcripts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format
from tests.llm.test_operators import SF


def test_repeated_rows_get_repeated_results(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "COPIES", 2)
    rows = [(1, 0, "User: hi"), (1, 1, "yes"), (1, 1, "yes"), (1, None, "AI: a\nUser: b"), (1, None, "AI: a\nUser: b")] + [(2, 5, "AI: same")] * 5 + [(None, None, None)] * 2
    out = chat_format.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert Counter((r.conv_id, r.turn, r.line, r.text) for r in out) == {(1, 0, 0, "hi"): 1, (1, 1, 0, "yes"): 2, (1, None, 0, "a"): 2, (1, None, 1, "b"): 2, (2, 5, 0, "same"): 5, (None, None, 0, ""): 2}


def test_crowds_without_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CROWD", 8)
    monkeypatch.setattr(chat_format, "CHUNK", 4)
    monkeypatch.setattr(chat_format, "FAN", 16)
    rng = random.Random(4)
    line = lambda: rng.choice(["User: {}", "AI: {}", "what of {}?", "{} plain", "### User: {}", "[system] {}"]).format(rng.randrange(10**6, 10**7))
    rows = [(c, rng.choice([None, -3, 0, 2, 2, 2, 9, 40]), line()) for c in (1, None) for _ in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    place = lambda t: -1 if t is None else max(-1, min(t, chat_format.LAST))
    plan = chat_format._uncrowded
    seen = []
    monkeypatch.setattr(chat_format, "_uncrowded", lambda x: seen.append(plan(x)) or seen[-1])
    out = chat_format.recover_roles(df).collect()
    assert seen[0].groupBy("conv", "idx").count().agg(F.max("count")).first()[0] <= 8
    for c in (1, None):
        lines = [g[3] for g in sorted(((place(t), hashes[x], t if t is not None else -(2**62), x) for k, t, x in set(rows) if k == c))]
        told = {next(x for x in lines if x == r.text or x.endswith(" " + r.text)): r for r in out if r.conv_id == c}
        # paths may tie, so their scores are compared
        assert _score(lines, [chat_format.ROLES.index(told[x].role) * 2 + told[x].begins for x in lines]) == pytest.approx(_best(lines))


def _score(lines, path):
    start, trans = np.full(chat_format.STATES, chat_format.LOW), chat_format.transitions()
    start[1::2] = np.log(chat_format.FIRST)
    return start[path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(chat_format.emissions(x)[p] for x, p in zip(lines, path, strict=True))


def _best(lines):
    score = np.full(chat_format.STATES, chat_format.LOW)
    score[1::2] = np.log(chat_format.FIRST)
    score = score + chat_format.emissions(lines[0])
    for x in lines[1:]:
        score = (score[:, None] + chat_format.transitions()).max(0) + chat_format.emissions(x)
    return score.max()


def test_whole_transcripts_come_apart(spark):
    """Each conversation of the table as one text: roles, beginnings and bodies against the truth."""
    turns = [r for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    style = [lambda r: f"{r.title()}: ", lambda r: f"[{r}] ", lambda r: f"### {r.title()}: ", lambda r: {"user": "Human: ", "assistant": "AI: ", "system": "System: "}[r]]
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append(r)
    rows = [(c, None, "\n".join(style[c % 4](r.role) + r.text for r in own)) for c, own in by.items()]
    got = {}
    for r in chat_format.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, text string")).orderBy("line").collect():
        got.setdefault(r.conv_id, []).append(r)
    right = total = 0
    for c, own in by.items():
        total += len(own)
        want = {(r.role, r.text) for r in own}
        right += sum((r.role, r.text) in want for r in got[c])
        assert "".join(r.rendered for r in got[c]).count("<|") == sum(r.begins for r in got[c])
    assert right / total >= 0.98


def test_long_lines_and_texts(spark):
    long = "User: " + "word " * 200_000 + "?\nAI: fine"
    out = chat_format.recover_roles(spark.createDataFrame([(1, 0, long), (1, 1, "ok\n" * 20_000)], "conv_id long, turn long, text string")).collect()
    assert sorted((r.turn, r.line, r.role) for r in out)[:2] == [(0, 0, "user"), (0, 1, "assistant")]
    assert sum(r.text.count("\n") + 1 for r in out if r.turn == 1) == 20_001
    assert np.isfinite([r.line for r in out]).all()
