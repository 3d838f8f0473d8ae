"""Stored sketches, Variant columns, the table function over partitions, and timers."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import funnels, variants
from millrace.operators import sketches
from millrace.streaming import timers
from millrace.streaming import windows as st
from tests.test_operators import DAY, HOUR, T0, stream_of


def test_merged_sketches_are_as_good_as_direct_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(days=rng.randrange(9)), rng.randrange(3000), rng.gauss(0, 5)) for _ in range(8000)] + [("c", T0, None, None), ("a", None, 1, 2.0), (None, T0, 5, 1.0)]
    df = spark.createDataFrame(rows, "g string, t timestamp_ntz, u long, v double").repartition(4)
    by_day = sketches.sketched(df, ["g"], "t", "u", "v")
    days = F.col("period").between(T0, T0 + dt.timedelta(days=4))
    told = lambda m: {r.g: r for r in m.select("g", "n", sketches.distinct_count().alias("u"), *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))]).collect()}
    got = told(sketches.merged(by_day, ["g"], days))
    direct = told(sketches.merged(sketches.sketched(df.where(F.col("t") < T0 + dt.timedelta(days=5)), ["g"], "t", "u", "v", "year"), ["g"]))
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g and r[1] and r[1] < T0 + dt.timedelta(days=5)]
        users, values = len({r[2] for r in own}), sorted(r[3] for r in own)
        for x in (got[g], direct[g]):
            assert x.n == len(own) and abs(x.u - users) <= 0.05 * users
            assert all(abs(sum(v <= q for v in values) / len(values) - p) < 0.015 for p, q in ((0.1, x.q0), (0.5, x.q1), (0.9, x.q2)))
    assert got["c"].u == 0 and got["c"].q1 is None and got["c"].n == 1 and got[None].u == 1
    assert sketches.merged(by_day.where("false"), ["g"]).count() == 0


def test_variants(spark):
    texts = ['{"k": 1}', '{"k": null}', '{"k": {"a": [1, "x"]}}', "bad{", None, "{}", '{"k": "7"}', '{"k": "x"}', "", '{"k": 12345678901234}', '[{"k": 3}]']
    df = variants.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, j string"), "j", "v")
    got = {r.i: tuple(r)[1:] for r in df.select("i", variants.typed("v", "$.k", "int").alias("k"), variants.told("v", "$.k").alias("told"), variants.typed("v", "$.k.a[1]", "string").alias("deep")).collect()}
    # a number in quotes is taken as a number, one too large for the type isn't
    assert [got[i] for i in range(11)] == [(1, "value", None), (None, "null", None), (None, "value", "x"), (None, "broken", None), (None, "broken", None), (None, "nothing", None), (7, "value", None), (None, "value", None), (None, "broken", None), (None, "value", None), (None, "nothing", None)]
    kinds = {r.g: r.schema for r in variants.schema_by(df.withColumn("g", F.when(F.col("i").isin(0, 9), "numbers").when(F.col("i").isin(0, 1, 2), "mixed").when(F.col("i").isin(3, 4), "none")), ["g"], "v").collect()}
    assert kinds["numbers"] == "OBJECT<k: BIGINT>" and kinds["mixed"] == "OBJECT<k: OBJECT<a: ARRAY<VARIANT>>>" and kinds["none"] == "VOID"


def test_funnel(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, 4, None]), T0 + dt.timedelta(hours=rng.randrange(20)), i, rng.choice(["a", "b", "c", None])) for i in range(120)] + [(9, T0, 500, "b"), (9, None, 501, "a"), (8, T0, 600, "a"), (8, T0, 601, "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "u int, t timestamp_ntz, i int, kind string, reached string").repartition(3)
    got = {r.u: tuple(r)[1:] for r in funnels.funnel(df, "u", "t", "i", "kind", ["a", "b", "c"]).collect()}
    want = {}
    for u in {r[0] for r in rows}:
        times = []
        for _, t, _, kind in sorted((r for r in rows if r[0] == u and r[1] is not None), key=lambda r: (r[1], r[2])):
            if len(times) < 3 and kind == "abc"[len(times)]:
                times.append(t)
        want[u] = (len(times), *times, *[None] * (3 - len(times)))
    assert got == want and want[8][0] == 2 and want[9][0] == 0
    out = funnels.funnel(df.where("false"), "u", "t", "i", "kind", ["x"])
    assert out.columns == ["u", "reached", "x"] and dict(out.dtypes)["x"] == "timestamp_ntz" and out.count() == 0
    with pytest.raises(PySparkException, match="repeat"):
        funnels.funnel(df, "u", "t", "i", "kind", ["a", "a"]).count()


def test_silent_users_are_told_once(spark, tmp_path):
    # user 1 is silent after two batches; a row of user 1 that is late, but within the watermark's delay, joins two visits
    batches = [[(1, 0, "a"), (2, 0, "a")], [(1, 2 * HOUR, "a"), (2, 5 * HOUR, "a"), (2, 12 * HOUR, "a")], [(2, 11 * HOUR + 1800, "a"), (1, 12 * HOUR, "a")], [(3, 2 * DAY, "a")], [(1, 60, "late"), (3, 2 * DAY + 1, "a")], [(1, 3 * DAY, "a")], [(4, 9 * DAY, "a")]]
    out = st.drain(timers.silent(stream_of(spark, tmp_path, batches), "user_id", "ts", "event_id", keep=2), "append").collect()
    h = lambda s: T0 + dt.timedelta(seconds=s)
    got = sorted((r.user_id, r.start_ts, r.last_ts, r.n) for r in out)
    assert got == [(1, h(0), h(2 * HOUR), 2), (1, h(12 * HOUR), h(12 * HOUR), 1), (1, h(3 * DAY), h(3 * DAY), 1), (2, h(0), h(5 * HOUR), 2), (2, h(11 * HOUR + 1800), h(12 * HOUR), 2), (3, h(2 * DAY), h(2 * DAY + 1), 2)]
    assert {tuple(r.last_ids) for r in out if r.user_id == 2} == {(1, 3), (5, 4)}  # in order of time


def test_state_is_read_and_written_once_a_batch():
    import pandas as pd

    calls = []

    class Handle:
        rows: list = []

        def getListState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        def registerTimer(self, at):
            calls.append(f"register {at}")

        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    own = timers.Silence(3600, 2)
    own.init(Handle())
    at = [i * 7200 * 1_000_000 for i in range(500)]
    list(own.handleInputRows((1,), iter([pd.DataFrame({"at": at, "id": range(500)})]), None))
    assert calls == ["get", "put", "register 3600000"] and len(own.visits.rows) == 500
