"""The Python data source: round trips, splits, pushed filters, commits and aborts."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not, StringStartsWith

from millrace.sources import shards
from tests.oracle import SF

SCHEMA = "i int, d double, t string, at timestamp_ntz, day date, list array<string>, b binary"
NAN, INF = float("nan"), float("inf")


def rows():
    at = dt.datetime(2024, 1, 1)
    out = [(i, i / 2, f"t{i % 7}", at + dt.timedelta(hours=i), at.date() + dt.timedelta(days=i), ["x", None], b"\x00") for i in range(60)]
    return [*out, (None,) * 7, (100, NAN, "", None, None, [], b""), (101, INF, "é", None, None, None, None), (102, -INF, None, None, None, None, None)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    shards.write_shards(df.repartitionByRange(5, "i"), str(tmp_path / "t"))
    return str(tmp_path / "t"), df


def test_round_trip_in_splits(spark, table, monkeypatch):
    path, df = table
    back = shards.read_shards(spark, path)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.rdd.getNumPartitions() == len(shards.manifest(path)["files"]) > 2
    monkeypatch.setattr(shards, "SPLIT", 1)
    assert back.select("t").distinct().count() == 10


FILTERS = ["i > 30", "i >= 30 AND i < 41", "d = 3.5", "d > 1e6", "d <= 0", "d = double('NaN')", "d >= double('NaN')", "d < double('NaN')", "t LIKE 't3%'", "t IN ('t1', 'é')", "t IS NULL", "i IS NOT NULL AND t = ''", "i <=> NULL",
           "at >= TIMESTAMP_NTZ '2024-01-02 03:00:00'", "day < DATE '2024-01-09'", "NOT (i > 5)", "i % 2 = 0", "t = 't1' OR i = 2"]


def test_pushed_filters_change_nothing(spark, table):
    path, df = table
    for f in FILTERS:
        assert sorted(map(str, shards.read_shards(spark, path).where(f).collect())) == sorted(map(str, df.where(f).collect())), f


def test_filters_prune_files(spark, table):
    path, df = table
    every = shards.Reader(path, df.schema).partitions()
    for f, fewer in ((GreaterThan(("i",), 50), True), (EqualTo(("i",), 3), True), (LessThanOrEqual(("day",), dt.date(2024, 1, 3)), True), (In(("i",), (1,)), False)):
        r = shards.Reader(path, df.schema)
        assert list(r.pushFilters([f, Not(f)])) == [Not(f)] and r.filters == [f]
        assert (len(r.partitions()) < len(every)) == fewer
        assert sum(b.num_rows for s in r.partitions() for b in r.read(s)) == {"GreaterThan": 12, "EqualTo": 1, "LessThanOrEqual": 3, "In": 1}[type(f).__name__]
    assert shards.taken(StringStartsWith(("t",), "x")) and not shards.taken(GreaterThan(("s", "a"), 1))


def test_append_overwrite_and_empty(spark, tmp_path):
    path, one = str(tmp_path / "t"), spark.createDataFrame([(1, NAN)], "i int, d double")
    shards.write_shards(one, path)
    shards.write_shards(one, path)
    assert shards.read_shards(spark, path).count() == 2
    shards.write_shards(one.selectExpr("i + 1 AS i", "d"), path, "overwrite")
    assert [r.i for r in shards.read_shards(spark, path).collect()] == [2] and len(list((tmp_path / "t").glob("part-*"))) == 1
    shards.write_shards(one.where("false"), path, "overwrite")
    assert shards.read_shards(spark, path).count() == 0 and not list((tmp_path / "t").glob("part-*"))


def test_a_failed_job_leaves_the_table(spark, table, tmp_path):
    path, df = table
    before = sorted(f.name for f in (tmp_path / "t").iterdir())
    bad = spark.range(4, numPartitions=4).selectExpr("cast(if(id = 3, raise_error('no'), id) AS int) AS i")
    with pytest.raises(PySparkException):
        shards.write_shards(bad, path)
    assert set(before) == set(f.name for f in (tmp_path / "t").iterdir() if f.name in before)
    assert shards.read_shards(spark, path).count() == df.count()  # whatever files the failed tasks left, the manifest names none


def test_addresses():
    assert shards.file_system("file:/a/b")[1] == shards.file_system("file:///a/b")[1] == shards.file_system("/a/b")[1] == "/a/b"


def test_events_round_trip(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    shards.write_shards(e.repartition(3), str(tmp_path / "e"))
    back = shards.read_shards(spark, str(tmp_path / "e"))
    assert back.rdd.getNumPartitions() == 3 and back.exceptAll(e).count() == 0 == e.exceptAll(back).count()
    assert math.isclose(back.agg({"value": "sum"}).first()[0], e.agg({"value": "sum"}).first()[0])
