"""Near-duplicates: spanning links, pivots and splits of hot keys against all pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, simhash


def least(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_spanned_links():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (30, 10), (200, 190), (50, 2000)):
        at, to = rng.integers(0, n, (2, m))
        cut = m // 2
        found = simhash.spanned(n, [(at[:cut], to[:cut]), (at[cut:], to[cut:])])
        assert len(found[0]) == len(set(found[0].tolist()))
        assert least(n, zip(*found, strict=True)) == least(n, zip(at, to, strict=True))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_pivots_find_all_components(similarity):
    rng = np.random.default_rng(2)
    for trial in range(12):
        sets = []
        for _ in range(4):
            base = rng.choice(2000, rng.integers(5, 120), replace=False)
            for _ in range(12):
                base = np.where(rng.random(len(base)) < rng.choice([0, 0.02, 0.06, 0.12]), rng.integers(0, 2000, len(base)), base)
                sets.append(np.unique(base).astype(np.uint64))
        sets.append(np.zeros(0, np.uint64))
        sets = [sets[i] for i in rng.permutation(len(sets))]
        py = [set(s.tolist()) for s in sets]
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0
        want = [(i, j) for i in range(len(py)) for j in range(i + 1, len(py)) if alike(py[i], py[j]) >= similarity]
        got = simhash.exact(sets, similarity)
        assert set((min(x), max(x)) for x in got) <= set(want)
        assert least(len(py), got) == least(len(py), want), trial


def test_a_large_group_takes_few_comparisons():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 300, dtype=np.uint64)
    sets = [np.unique(np.append(base[rng.random(300) > 0.01], rng.integers(0, 2**60, 3, dtype=np.uint64))) for _ in range(2000)]
    began = time.time()
    assert set(least(2000, simhash.exact(sets, 0.8))) == {0}
    assert time.time() - began < 20


@pytest.mark.parametrize("tile", [3, 8])
def test_hot_keys_are_split(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(4)
    # all agree in the low 32 bits, so one key holds them all
    high = rng.integers(0, 1 << 32, 60, dtype=np.uint64) << np.uint64(32)
    fps = np.unique(np.concatenate([high, *[high ^ (np.uint64(1) << np.uint64(k)) for k in (32, 47, 63)], high ^ np.uint64(3 << 40)]) | np.uint64(0x1234))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = [(place[r.a], place[r.b]) for r in simhash.links(df).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    assert least(len(fps), got) == least(len(fps), want)


@pytest.mark.parametrize("tile, shingles", [(1024, 1 << 21), (1024, 150), (3, 1 << 21), (2, 1)])
def test_tiles_of_sets_change_nothing(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(3):
        words = [f"w{x}" for x in rng.integers(0, 500, 80)]
        for _ in range(7):
            words = [w if rng.random() > 0.01 else f"v{rng.integers(99)}" for w in words]
            texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    want = least(len(texts), [(i, j) for i in range(21) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8])
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 18, 0.8)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == want and len(set(want)) < 21


def test_sketches_keep_similar_sets():
    rng = np.random.default_rng(8)
    for n in (5, 10, 60, 500):
        for _ in range(300):
            both = rng.permutation(np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64)))
            cut = rng.integers(0, n // 5 + 1)  # the two differ in a fifth of both
            a, b = (simhash.sketch(np.sort(x)) for x in (both[cut:], np.append(both[:cut], both[n // 5 :])))
            assert simhash.agree([*a[:, None]], [*b[:, None]], 0.5).all()


def test_unlike_sets_of_one_shingle_are_no_candidates(spark):
    """Before, some of the fingerprints were near enough by chance to put most sets of a large key into one component, whose texts met in pairs of tiles."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(6000):
        s = np.unique(np.append(rng.integers(0, 2**64 - 1, 300, dtype=np.uint64), np.uint64(1)))
        rows.append((i, int(rng.integers(-(2**63), 2**63 - 1)), len(s), s[:1].view(np.int64).tolist(), simhash.sketch(s).view(np.int64).tolist()))
    rows += [(6000, *rows[0][1:])]
    sets = spark.createDataFrame(rows, "node long, fp long, size int, sample array<long>, sketch array<long>")
    assert [{r.a, r.b} for r in simhash.set_links(sets, 18, 0.8).collect()] == [{0, 6000}]


def test_marks_hold_all_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 1 << 17)
    rows = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    bits = common.marks(rows.where("k % 50 = 7 OR k IS NULL"), F.xxhash64("k"))
    some, rest = (common.marked(rows, F.xxhash64("k"), bits, how) for how in ("left_semi", "left_anti"))
    assert some.where("k % 50 = 7 OR k IS NULL").count() == 401 and some.count() < 800
    assert some.unionByName(rest).exceptAll(rows).count() == 0 and some.count() + rest.count() == 20000
