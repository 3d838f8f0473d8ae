"""Groups of similar sets against all pairs, and components against a union of sets."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import groups


def joined(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("hot", [1, 4096])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(groups, "HOT", hot)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == joined(nodes, [p for p in pairs if p[0] != p[1]])
    assert groups.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def similar(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def table(rng):
    rows = [(0, []), (1, None), (2, ["x"]), (3, ["x", "x"]), (4, [None, "x"])]
    for g in range(4):
        base = [f"w{rng.randrange(900)}" for _ in range(60)]
        for i in range(45):  # from equal to far, so that some rows of a band are beyond the distance of its hub
            rows.append((10 + g * 100 + i, [w if rng.random() > 0.004 * i else f"w{rng.randrange(900)}" for w in base]))
    return rows


@pytest.mark.parametrize("small", [2, 8, 32])
def test_groups_match_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(groups, "SMALL", small)
    rows = table(random.Random(2))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k long, w array<string>, group_id string").select("k", "w", "group_id").repartition(3)
    sets = {k: set(w or ()) for k, w in rows}
    every = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b]) >= 0.8]
    got = {r.k: r.group_id for r in groups.similar_groups(df.select("k", "w"), "k", "w", 0.8).collect()}
    assert got == joined(sets, every) and len(every) > 300
    links = groups.spanning_links(df, "k", "w", 0.8).collect()
    assert all(similar(sets[r.a], sets[r.b]) >= 0.8 and r.a < r.b and r.shared == len(sets[r.a] & sets[r.b]) and r.united == len(sets[r.a] | sets[r.b]) for r in links)


def test_near_copies_are_not_all_compared(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, [w if rng.random() > 0.004 else f"v{rng.randrange(50)}" for w in base]) for i in range(400)]
    links = groups.spanning_links(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 0.8)
    assert 399 <= links.count() < 20 * 400 < 400 * 399 / 2 / 5
    assert groups.components(links, "a", "b").agg(F.count_distinct("root")).first()[0] == 1


def test_empty_table(spark):
    assert groups.similar_groups(spark.createDataFrame([], "k long, w array<string>"), "k", "w", 0.8).count() == 0


def test_a_band_of_unlike_sets(spark):
    rng = random.Random(5)
    rows = [(i, [*(f"c{j}" for j in range(60)), *(f"w{rng.randrange(5000)}" for _ in range(40))]) for i in range(200)]
    rows.append((1000, rows[7][1][:95]))
    links = groups.spanning_links(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 0.8, bands=3, width=1).collect()
    assert [(r.a, r.b) for r in links] == [(7, 1000)]
