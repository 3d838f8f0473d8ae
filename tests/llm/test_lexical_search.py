"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical_search as ls

SCHEMA = "doc_id long, text string, score int, rank string, n int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def want(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n, length = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, _), c in zip(docs, counts, strict=True):
            m = 50 + 50 * c.total() * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rare = lambda: words[min(59, int(rng.expovariate(0.12)))]
    docs = [(i, " ".join(rare() for _ in range(int(rng.expovariate(0.03)) + 1))) for i in range(700)]
    docs += [(800 + i, docs[i][1]) for i in range(50)] + [docs[3], docs[3], (None, docs[4][1]), (None, "w1 w50"), (900, None), (901, ""), (902, " .,\n"), (903, "W1,ÉÀ w2-É_w3"), (904, "w59 " * 5000)]
    items = [(i, " ".join(rare() for _ in range(rng.randint(1, 30)))) for i in range(12)]
    items += [(50, None), (51, "?!"), (52, "nowhere"), (None, "w1 W1 é w2"), (None, "w9"), (3, "w50 w51"), (3, "w50 w51"), (53, "ÉÀ")]
    return docs, items


@pytest.mark.parametrize("k, shard, window, most, parts", [(50, 1 << 15, 1 << 11, 1 << 20, 3), (5, 64, 16, 60, 4), (1, 1000, 1, 1 << 20, 1), (7, 100, 7, 1 << 20, 5)])
def test_search_matches_brute_force(spark, k, shard, window, most, parts):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(parts)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")
    got = ls.search(d, q, k, shard, window, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want(docs, items, k)


def test_documents_are_skipped():
    rng = np.random.default_rng(1)
    n, v = 20_000, 40
    doc = np.concatenate([np.sort(rng.choice(n, int(n * 0.9 / (t + 1)) + 1, replace=False)) for t in range(v)])
    term = np.repeat(np.arange(v), [int(n * 0.9 / (t + 1)) + 1 for t in range(v)])
    order = np.lexsort((term, doc))
    df = np.bincount(term, minlength=v)
    s = ls.Shard(np.arange(n), np.full(n, 100), doc[order], term[order], rng.integers(1, 4, len(doc)), ls.weights(df, n), n, 100 * n)
    heap = ls.Heap(10)
    scored = ls.wand(s, np.array([0, 1, 35, 39]), heap, 64)
    assert 0 < scored < n / 4
    total = np.zeros(n)
    for t in (0, 1, 35, 39):
        total[s.doc[s.at[t] : s.at[t + 1]]] += s.impact[s.at[t] : s.at[t + 1]]
    best = np.lexsort((np.arange(n), -total))[:10]
    assert heap.ids.tolist() == best.tolist() and heap.score.tolist() == total[best].tolist()


def test_pieces_of_long_texts():
    t = " ".join(random.Random(2).choice(["Ab", "é", "x-y", "1"]) for _ in range(2000)).encode()
    for size in (1, 7, 1000, 1 << 20):
        assert [w for p in ls.pieces(t, size) for w in p.split()] == t.translate(ls.TABLE).split()
    assert list(ls.pieces(b"", 5)) == [b""] and list(ls.pieces(b"abcdefgh", 2)) == [b"abcdefgh"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    item = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.search(none, item).count() == 0
    assert ls.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), item.where("false")).count() == 0
