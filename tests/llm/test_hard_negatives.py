"""Hard negatives against the scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<double>, key string, rank int"


def want(rows, anchor):
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, l, v in {(i, l, tuple(v)): (i, l, v) for i, l, v in ok if i is not None and anchor(i)}.values():
        scored = sorted([(-dot(v, w), last(j), j, m) for j, m, w in ok])
        for s, _, p, _ in [x for x in scored if x[3] == l and x[2] != i][:5]:
            near = [x for x in scored if x[3] != l and -80 * s <= -100 * x[0] <= -100 * s][:5]
            out += [(i, p, rank + 1, n, -s, -t) for rank, (t, _, n, _) in enumerate(near)]
    return sorted(map(str, out))


def table():
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(3)]
    rows = []
    for i in range(400):
        k = rng.randrange(3)
        rows.append((i, k if rng.random() < 0.7 else rng.randrange(3), [x + rng.gauss(0, 0.4) for x in centre[k]]))
    v = rows[0][2]
    rows += [(1000, 1, [])] + [(1001 + i, i % 3, v) for i in range(9)]  # ties
    rows += [rows[5], rows[5], rows[100], rows[100], (None, 0, v), (None, 1, v), (0, 2, v), (20, 0, None), (21, None, v), (22, 0, [1.0, None]), (23, 0, [math.nan]), (24, 0, [math.inf]), (25, 2, v[:3]), (40, 9, v), (60, 0, [0.0] * 7), (80, 0, [-x for x in v])]
    return rows


@pytest.mark.parametrize("rows_of, anchors_of, fit", [(8192, 256, 4096), (50, 3, 30), (7, 1, 1)])
def test_mining_matches_brute_force(spark, monkeypatch, rows_of, anchors_of, fit):
    monkeypatch.setattr(hn, "ROWS", rows_of)
    monkeypatch.setattr(hn, "ANCHORS", anchors_of)
    monkeypatch.setattr(hn, "FIT_ROWS", fit)
    rows = table()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = hn.mine(df, F.col("id") % 20 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == want(rows, lambda i: i % 20 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.floor(256 * (rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 16)))).astype(np.int64)
    books = hn.fit(x[:500])
    codes, norms = hn.encode(x, books)
    pack = lambda a: a.astype(np.int64).tobytes()
    n = np.arange(len(x))
    r = hn.Block(pack(n), pack(n), pack(n % 3), codes.tobytes(), pack(norms), pack(x))
    q = hn.Block(pack(n[:8]), pack(n[:8]), pack(n[:8] % 3), b"", pack(hn.root_up((x[:8] ** 2).sum(1))), pack(x[:8]))
    low, high = hn.bounds(q, n[:8], r, n, books)
    score = x[:8] @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high >= np.partition(low, -5, axis=1)[:, -5:-4]).mean() < 0.1  # so few are left to score


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], "", 1), (1, 1, [1.0], "", 1)], SCHEMA)
    assert hn.mine(one, F.col("id") % 2 == 0).count() == 0  # no row of another label
    with pytest.raises(ValueError, match="62 bits"):
        hn.mine(spark.createDataFrame([(0, 1, [1e12], "", 1)], SCHEMA), F.col("id") % 2 == 0)


def test_repeated_anchors_are_not_broadcast(spark):
    """Spark estimates the anchors by their file, not by their repeats, all of which a broadcast would gather on the driver."""
    columns = hn.BLOCK.replace(" binary", "").split(", ")
    blocks = common.written(spark.range(40).select(*[F.lit(b"x").alias(c) for c in columns]))
    pairs = hn._pairs(blocks, blocks, 7)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 1600


def test_sample_is_thinned_before_it_is_sorted(spark, monkeypatch):
    monkeypatch.setattr(hn, "FIT_ROWS", 50)
    rows = spark.range(20000).select("id", F.col("id").alias("key"))
    few = hn._lowest(rows, 20000)
    low = lambda df: [r.id for r in df.orderBy(F.xxhash64("id", "key")).limit(50).collect()]
    assert 50 <= few.count() < 200 and low(few) == low(rows)
