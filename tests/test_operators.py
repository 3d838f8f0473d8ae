"""Core operators on small inputs of their own: nulls, ties, hot keys, odd types, late and split streams."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import udfs
from millrace.operators import grouping, joins, search
from millrace.session import scratch, shared_dir
from millrace.sources import files
from millrace.streaming import windows as st

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentile_is_exact(spark, q, accuracy):
    rng = random.Random(1)
    rows = [("a", float(rng.choice([1, 1, 1, 2, 3, 1e9]))) for _ in range(500)] + [("b", rng.gauss(0, 1)) for _ in range(301)] + [("c", None), ("d", 7.0), (None, 1.0), (None, 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.x for r in grouping.percentile(df, ["k"], "v", q, "x", accuracy).collect()}
    want = {r.k: r.x for r in df.groupBy("k").agg(F.percentile("v", q).alias("x")).collect()}
    assert set(got) == set(want)
    assert all(got[k] is None and want[k] is None or math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_asof_join_over_buckets(spark, bucket):
    rng = random.Random(2)
    some = lambda n: [(rng.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(minutes=30 * rng.randrange(200)), i) for i in range(n)]
    left, right = some(150), some(80)
    l, r = (spark.createDataFrame(x, f"k int, t timestamp_ntz, {n} int") for x, n in ((left, "i"), (right, "j")))
    got = {x.i: x.asof_j for x in joins.asof_join(l, r, ["k"], "t", ["j"], bucket=bucket).collect()}
    for k, t, i in left:
        before = [(u, j) for m, u, j in right if m == k and u <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_interval_join(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice([1, 1, 2, None]), T0 + dt.timedelta(seconds=rng.randrange(40_000)), i) for i in range(n)]
    left, right = [*some(120), (1, T0, 500), (1, None, 501)], [*some(120), (1, T0 + dt.timedelta(hours=1), 600), (1, T0 + dt.timedelta(seconds=3601), 601)]
    l = spark.createDataFrame(left, "k int, a timestamp_ntz, i int")
    r = spark.createDataFrame(right, "k int, b timestamp_ntz, j int")
    got = sorted((x.i, x.j) for x in joins.interval_join(l, r, ["k"], "a", "b", 3600).collect())
    want = sorted((i, j) for k, a, i in left for m, b, j in right if k == m and k is not None and a and b and dt.timedelta(0) <= b - a <= dt.timedelta(hours=1))
    assert got == want and (500, 600) in got and (500, 601) not in got


def test_range_join_of_narrow_and_wide_ranges(spark):
    rng = random.Random(7)
    left = [(i, rng.choice([None, -3.0, rng.uniform(-50, 50)])) for i in range(80)]
    right = [(i, lo := rng.uniform(-60, 60), lo + rng.choice([0.5, 3.0, 0.0, -1.0])) for i in range(40)] + [(100, -1e6, 1e6), (101, -3.0, 1e12), (102, None, 5.0), (103, -1e300, -3.0), (104, -1e300, 1e300)]
    l, r = spark.createDataFrame(left, "i int, at double"), spark.createDataFrame(right, "j int, low double, high double")
    for own in (right, right[:40]):
        got = joins.range_join(l, r.where(F.col("j").isin([x[0] for x in own])), "at", "low", "high", 1.0).collect()
        assert sorted((x.i, x.j) for x in got) == sorted((i, j) for i, a in left for j, lo, hi in own if None not in (a, lo, hi) and lo <= a < hi)


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_salted_join(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(2)) for i in range(200)]
    right = [("a", 0, 1), ("a", 0, 2), ("a", 1, 3), ("b", 1, 4), (None, 0, 5), ("z", 0, 6)]
    l, r = spark.createDataFrame(left, "i int, k string, m int"), spark.createDataFrame(right, "k string, m int, v int")
    got = joins.salted_join(l, r, ["k", "m"], 5)
    assert set(got.columns) == {"i", "k", "m", "v"}
    assert sorted((x.i, x.v) for x in got.collect()) == sorted((i, v) for i, k, m in left for n, o, v in right if k == n and k is not None and m == o)
    assert joins.salted_join(l.where("false"), r, ["k", "m"]).count() == 0


def test_similar_sets(spark):
    rng = random.Random(5)
    rows = [(0, []), (1, None), (2, ["x"]), (3, ["x", "x"]), (4, [None, "x"])]
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 80))]
        rows += [(10 + g * 5 + k, [x if rng.random() > 0.04 * k else f"w{rng.randrange(500)}" for x in base]) for k in range(5)]
    got = {(r.a, r.b): r.shared / r.united for r in search.similar_sets(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 0.8).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and (s := len(set(a) & set(b)) / len(set(a) | set(b))) >= 0.8:
                want[i, j] = s
    assert got == want and (2, 3) in got and len(got) > 20


def test_combined_and_split_python_aggregates(spark):
    rows = [(i % 3 if i % 7 else None, float(i + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    got = {r.k: r.g for r in udfs.geometric_mean(df, "k", "v").collect()}
    assert set(got) == set(by) and all(math.isclose(got[k], math.exp(sum(map(math.log, v)) / len(v)), rel_tol=1e-12) for k, v in by.items())
    for size in (10, 100_000):
        got = sorted((str(r.k), round(r.d, 6)) for r in udfs.demean(df, "k", "v", size).collect())
        assert got == sorted((str(k), round(v - sum(by[k]) / len(by[k]), 6)) for k, v in rows)


ODD = "i int, d decimal(12,3), day date, raw binary, m map<string,int>, s struct<a:int,b:array<string>>, f boolean, t timestamp_ntz"


def test_odd_types_pass_sources_and_sinks(spark):
    from decimal import Decimal

    rows = [
        (1, Decimal("12.345"), dt.date(2024, 2, 29), b"\x00\xff", {"a": 1, "b": None}, (1, ["x", None]), True, T0),
        (2, None, None, None, None, None, None, None),
        (None, Decimal("-0.001"), dt.date(1, 1, 1), b"", {}, (None, []), False, dt.datetime(9999, 12, 31, 23, 59, 59)),
    ]
    df = spark.createDataFrame(rows, ODD)
    for fmt in ("parquet", "orc", "json"):
        path = scratch(spark, fmt)
        files.write(df, path, fmt)
        back = files.read(spark, path, fmt, ODD).collect()
        assert sorted(map(str, back)) == sorted(map(str, df.collect())), fmt
    part = scratch(spark, "parts")
    files.write(df, part, by=["i"])
    assert files.read(spark, part).where("i = 2").count() == 1
    gaps = spark.sql("SELECT INTERVAL '3' DAY AS g UNION ALL SELECT CAST(NULL AS INTERVAL DAY)")
    assert {r.g for r in gaps.agg(F.sum("g").alias("g")).collect()} == {dt.timedelta(days=3)}


def stream_of(spark, tmp_path, batches):
    """A stream that takes the batches one by one: rows (user, seconds after T0, type)."""
    n = 0
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n + k, T0 + dt.timedelta(seconds=s), u, kind) for k, (u, s, kind) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{i:02}"))
        n += len(rows)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(str(tmp_path))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


HOUR, DAY = 3600, 86_400


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    late = [[(1, 0, "a"), (1, 10, "a")], [(1, 3 * DAY, "a")], [(1, 3 * DAY + 5, "a")], [(1, 20, "a")], [(1, 9 * DAY, "a")]]
    out = st.drain(st.tumbling(stream_of(spark, tmp_path, late)), "append").collect()
    # day 0 has closed when its third row comes, as rows are late by the watermark of the batch before; the last window stays open
    assert sorted((r.start_ts, r.n) for r in out) == [(T0, 2), (T0 + dt.timedelta(days=3), 2)]


def test_sessions_go_on_over_batches(spark, tmp_path):
    batches = [[(1, 0, "a"), (2, 0, "a")], [(1, 5 * HOUR, "a")], [(1, 10 * HOUR, "a"), (2, 7 * HOUR, "a")], [(3, 99 * HOUR, "a")]]
    out = st.drain(st.session(stream_of(spark, tmp_path, batches)), "append").collect()
    assert sorted((r.user_id, r.start_ts, r.n) for r in out) == [(1, T0, 3), (2, T0, 1), (2, T0 + dt.timedelta(hours=7), 1)]


def test_repeats_over_batches(spark, tmp_path):
    out = st.drain(st.deduplicated(stream_of(spark, tmp_path, [[(1, 0, "a")], [(1, 60, "a"), (1, 61, "b")], [(1, DAY, "a")]])), "append").collect()
    assert sorted((r.user_id, r.event_type) for r in out) == [(1, "a"), (1, "b")]


def test_stream_join_over_batches(spark, tmp_path):
    batches = [[(1, 0, "view")], [(1, 1800, "purchase"), (2, 1800, "purchase")], [(1, 3600, "purchase"), (1, 3601, "purchase")]]
    out = st.drain(st.view_then_purchase(stream_of(spark, tmp_path, batches)), "append").collect()
    assert sorted((r.view_id, r.purchase_id) for r in out) == [(0, 1), (0, 3)]


def test_state_over_batches(spark, tmp_path):
    before = spark.conf.get(st.STORE, None)
    out = st.drain(st.running_counts(stream_of(spark, tmp_path, [[(1, 0, "a"), (2, 1, "a")], [(1, 2, "a")], [(1, 3, "a"), (3, 3, "a")]])), "update")
    assert {r.user_id: r.n for r in out.groupBy("user_id").agg(F.max("n").alias("n")).collect()} == {1: 3, 2: 1, 3: 1}
    assert spark.conf.get(st.STORE, None) == before


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_streams_without_rows(spark, tmp_path, mode):
    s = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path))
    out = st.drain(st.tumbling(s), mode)
    assert out.count() == 0 and set(out.columns) == {"event_type", "n", "start_ts"}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Sc:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Fake:
        sparkContext = Sc()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake())
    assert scratch(spark, "x") != scratch(spark, "x")
