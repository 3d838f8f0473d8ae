"""Decontamination against a brute force over words, of every window and item."""

import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import contamination
from tests.llm.test_operators import docs, empty, texts  # noqa: F401


def brute_force(rows, items):
    """(doc, item) -> greatest similarity of 0.8 or more; items and rows are lists of (id, bytes or None)."""
    split = [(i, (t or b"").lower().split()) for i, t in items]
    split = [(i, w) for i, w in split if w]
    of = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    held = [Counter(of(w, min(5, len(w)))) for _, w in split]
    spread = Counter(s for h in held for s in h)
    weight = {s: np.log(1 + len(split) / n) for s, n in spread.items()}
    out = {}
    for d, t in rows:
        words = (t or b"").lower().split()
        for (item, w), h in zip(split, held, strict=True):
            k, total = min(5, len(w)), sum(n * weight[s] for s, n in h.items())
            every = of(words, k)
            if not any(s in h for s in every):
                continue
            m = min(len(w) - k + 1, len(every))
            for at in range(len(every) - m + 1):
                have = Counter(every[at : at + m])
                got = sum(min(n, have[s]) * weight[s] for s, n in h.items()) / total
                if got >= 0.8 - 1e-12:
                    out[d, item] = max(out.get((d, item), 0), got)
    return out


def test_matches_brute_force(spark, docs, empty):  # noqa: F811
    t = [x for x in texts() if x]
    passage = " ".join(t[5].split()[10:40])
    items = [(1, passage), (2, "never seen anywhere at all in these texts"), (3, None), (4, ""), (5, " ".join(t[14].split()[100:160])), (5, passage), (6, "two WORDS"), (7, "one"), (None, passage)]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_force([(i, (x or "").encode()) for i, x in rows], [(i, (x or "").encode()) for i, x in items])
    found = contamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in want.items()} and (7, 1) in want
    # a row for each item and for each row of a repeated document
    assert Counter((r.doc_id, r.item_id) for r in found)[7, 5] == 2
    for r in found:
        assert any(0 <= r.first_word <= max(0, len((x or "").split()) - r.n_words) for i, x in rows if i == r.doc_id)
    assert contamination.contaminated(empty, bench).count() == 0
    assert contamination.contaminated(docs, bench.where("false")).count() == 0
    kept = contamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({d for d, _ in want} - {None})


def near_copies(n=400):
    """Items, and documents that hold copies of them with some words changed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(12)]
    items = [(i, " ".join([*common[:6], *[word() for _ in range(rng.randint(9, 60))]] if i % 5 == 0 else [word() for _ in range(rng.randint(6, 60))]).encode()) for i in range(60)]
    rows = []
    for d in range(n):
        w = rng.choice(items)[1].split()
        changed = [word().encode() if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else x for x in w]
        at = rng.randint(0, 80)
        rows.append((d, b" ".join([word().encode() for _ in range(at)] + changed + [word().encode() for _ in range(60)])))
    return items, rows


def test_recall_of_near_copies():
    items, rows = near_copies()
    want = brute_force(rows, items)
    index = contamination.Index([i for i, _ in items], [t for _, t in items])
    got = {(d, i): s for (d, _), own in zip(rows, index.search([t for _, t in rows]), strict=True) for i, s, *_ in own}
    assert set(got) <= set(want)
    less = {k for k, s in want.items() if s < 1 - 1e-9}
    assert len(less) > 80 and len(less & set(got)) / len(less) >= 0.9
    assert (set(want) - less) <= set(got)


def test_index_finds_all_within_the_radius():
    items, _ = near_copies(1)
    index = contamination.Index([i for i, _ in items], [t for _, t in items])
    rng = np.random.default_rng(2)
    for size, (own, _) in index.near.items():
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(300)], np.uint64)
        prints = index.fingerprints[rng.choice(own, 300)] ^ flips
        near = {(w, i) for w in range(300) for i in own.tolist() if int(prints[w] ^ index.fingerprints[i]).bit_count() <= contamination.RADIUS}
        assert {(w, i) for ws, found in index.candidates(prints, size) for w, i in zip(ws.tolist(), found.tolist(), strict=True)} == near


@pytest.mark.parametrize("most", [700, 3000])
def test_blocks_of_the_benchmark_change_nothing(spark, most):
    items, rows = near_copies(60)
    bench = spark.createDataFrame([(i, t.decode()) for i, t in [*items, (99, items[0][1])]], "item_id long, text string")
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string")
    pairs = lambda **x: sorted(map(tuple, contamination.contaminated(df, bench.where("item_id < 12 OR item_id = 99"), **x).drop("text_key").collect()))
    assert pairs(most=most) == pairs() != []


def test_long_texts_are_read_to_their_end(monkeypatch):
    monkeypatch.setattr(contamination, "SEGMENT", 7)
    items, rows = near_copies(40)
    index = contamination.Index([i for i, _ in items], [t for _, t in items])
    short = index.search([t for _, t in rows])
    monkeypatch.undo()
    assert short == index.search([t for _, t in rows])
    deep = b"filler words here " * 50_000 + items[3][1] + b" and more" + b"x" * 2_000_000
    (found,) = index.search([deep])
    assert [(i, round(s, 9), p) for i, s, p, _ in found] == [(3, 1.0, 150_000)]


@pytest.mark.parametrize("n", [2, 7])
def test_shared_shingles_vote_alike_in_any_block(n):
    """Items of one stock of phrases, so that most of their shingles stand in items of other blocks too; copies at the edge of the radius."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    stock = [" ".join(word() for _ in range(8)) for _ in range(60)]
    items = [(i, " ".join([rng.choice(stock), rng.choice(stock), *(word() for _ in range(rng.randint(0, 12))), rng.choice(stock)]).encode()) for i in range(400)]
    texts = [" ".join(w if rng.random() > 0.03 else word() for w in rng.choice(items)[1].decode().split()).encode() for _ in range(300)]
    spread = Counter(h for _, t in items for h in np.unique(contamination.item_shingles(t)).view(np.int64).tolist())
    found = lambda some: [set(own) for own in contamination.Index([i for i, _ in some], [t for _, t in some], spread, len(items)).search(texts)]
    whole, parts = found(items), [found(items[k::n]) for k in range(n)]
    assert sum(map(len, whole)) > 150
    assert [set().union(*own) for own in zip(*parts, strict=True)] == whole
