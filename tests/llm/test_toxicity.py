"""Toxicity: gains, a training step and scores against plain loops; few labels, misspellings, bounds."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity


def plain_windows(text):
    """Buckets of a text's windows, one by one."""
    out = []
    for w in text.lower().split():
        w = b" " + w + b" "
        for k in toxicity.SIZES:
            for i in range(len(w) - k + 1):
                h = (2166136261 + k) & 0xFFFFFFFF
                for x in w[i : i + k]:
                    h = ((h ^ x) * 16777619) & 0xFFFFFFFF
                out.append((h ^ h >> 15) & ((1 << toxicity.BUCKET_BITS) - 1))
    return out


TEXTS = [b"", b"one two", b"A bad, bad word", b"\tbad\n\nword two ", "schön é".encode(), b"x" * 40]


def test_scores_are_plain_means():
    rng = np.random.default_rng(0)
    score = rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    want = []
    for t in TEXTS:
        w = plain_windows(t)
        want.append(1 / (1 + np.exp(-(np.mean(score[w]) if w else 0) - 0.3)))
    assert np.allclose(toxicity.score_texts(TEXTS, score, 0.3), want, atol=1e-6)


def test_gains_are_plain_log_odds():
    y = np.array([0, 1, 1, 0, 0, 1.0])
    rows, ids, _ = (np.concatenate(c) for c in zip(*toxicity.bags(TEXTS), strict=True))
    got = toxicity.gains(ids, rows, y)
    sets = [set(plain_windows(t)) for t in TEXTS]
    assert set(np.flatnonzero(got).tolist()) <= set().union(*sets)
    a = toxicity.SMOOTH + toxicity.LEAST / 3
    for w in set().union(*sets):
        p, q = (sum(w in s for s, v in zip(sets, y, strict=True) if v == c) / 3 for c in (1, 0))
        assert got[w] == pytest.approx(np.log((p + a) / (q + a)) ** 2, abs=1e-6)


def plain_training(texts, y, epochs, rate, seed):
    """train() with whole gradients of every parameter, text by text."""
    rng = np.random.default_rng(seed)
    rows, ids, _ = (np.concatenate(c) for c in zip(*toxicity.bags(texts), strict=True))
    gain = toxicity.gains(ids, rows, y)
    bags = [plain_windows(t) for t in texts]
    seen = {b: i for i, b in enumerate(sorted({b for x in bags for b in x}))}
    table, weight, bias = rng.normal(0, 0.01, (len(seen), toxicity.DIMS)), rng.normal(0, 1, (toxicity.DIMS, 2)), np.zeros(2)
    m, v, step = {}, {}, 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(y)), max(1, min(16, len(y) // 32))):
            step += 1
            row, out, b = np.zeros(len(seen)), np.zeros_like(weight), np.zeros(2)
            for i in batch:
                x = np.zeros(len(seen))
                for w in bags[i]:
                    x[seen[w]] += toxicity.SCALE * gain[w] / len(bags[i])
                logits = (x @ table) @ weight + bias
                p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
                err = (p - np.eye(2)[int(y[i])]) / len(batch)
                # the loss's gradient in the table is x (outer) weight @ err, one number a row times the weights' difference
                row += x * err[1]
                out += np.outer(x @ table, err)
                b += err
            diff = weight[:, 1] - weight[:, 0]
            for name, g in (("row", row), ("weight", out), ("bias", b)):
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
            move = {k: lr * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m[k] / (np.sqrt(v[k]) + 1e-8) for k in m}
            table = table - move["row"][:, None] * diff / np.linalg.norm(diff)
            weight, bias = weight - move["weight"], bias - move["bias"]
    return {b: toxicity.SCALE * gain[b] * (table[i] @ (weight[:, 1] - weight[:, 0])) for b, i in seen.items()}, bias[1] - bias[0]


def test_training_is_plain_gradient_descent():
    rng = random.Random(1)
    texts = [b" ".join(rng.choice([b"one", b"two", b"bad", b"good", b"words"]) for _ in range(6)) for _ in range(70)]
    y = np.array([float(b"bad" in t) for t in texts])
    score, bias = toxicity.train(texts, y, epochs=3, rate=0.01)
    want, b = plain_training(texts, y, 3, 0.01, 7)
    assert bias == pytest.approx(b, abs=1e-3)
    assert np.allclose([score[k] for k in want], list(want.values()), atol=0.02 * max(map(abs, want.values())))


def corpus(rows, bad, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(rows):
        w = [rng.choice(words) for _ in range(80)]
        if i % 5 == 0:
            w[10] = w[30] = rng.choice(bad)
        texts.append(" ".join(w).encode())
        labels.append(i % 5 == 0)
    return texts, np.array(labels, float)


def test_few_labels_give_varying_scores():
    texts, y = corpus(60, ["wretched"])
    score, bias = toxicity.train(texts, y)
    s = toxicity.score_texts(texts, score, bias)
    assert s.std() > 0.1 and s[y == 1].mean() > s[y == 0].mean() + 0.3


def test_unseen_misspellings_share_vectors():
    texts, y = corpus(600, ["wretched", "loathsome", "pathetic"])
    score, bias = toxicity.train(texts, y)
    clean = [t for t, v in zip(corpus(200, ["x"], 1)[0], y, strict=False) if not v]
    plain = toxicity.score_texts(clean, score, bias)
    assert (plain < 0.5).mean() > 0.98
    for word in (b"wretchedd", b"wrretched", b"loathsomme", b"pathetics", b"patthetic", b"unpathetic"):
        odd = [b" ".join([*t.split()[:20], word, *t.split()[20:40], word, *t.split()[40:]]) for t in clean]
        assert (toxicity.score_texts(odd, score, bias) >= 0.5).mean() > 0.9, word


def test_held_out_rows_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.query(spark, d).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.predicted == y for r, y in held) / len(held) >= 0.95
    # a few of the labels are wrong, so not all toxic ones can be told
    assert sum(r.predicted for r, y in held if y) >= 4
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


def test_sample_is_bounded_and_ids_may_repeat(spark):
    rows = [(i, f"text {i} " * (i % 4 + 1)) for i in range(60)] + [(1, "again")] * 9 + [(2, None), (None, "no id"), (3, "long " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(1, 0, "x"), (1, 1, "x"), (None, 1, "x"), (5, None, "x"), (6, 7, "x")], "doc_id long, toxic int, text string")
    texts, y, share = toxicity.training_rows(docs, labels, 40, 600)
    assert 0 < len(texts) == len(y) <= 60 and sum(map(len, texts)) <= 600 and 0.4 < share < 0.6
    every, y, _ = toxicity.training_rows(docs, labels, 1000, 1 << 20)
    assert len(every) == len({(t, v) for t, v in zip(every, y.tolist(), strict=True)}) and b"again" in every
    none = labels.where("false")
    assert {round(r.score, 3) for r in toxicity.toxicity(docs, none).collect()} == {0.25}
