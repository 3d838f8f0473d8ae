import re

import pytest

from millrace.operators import search
from millrace.plans import registry
from millrace.sources import files
from tests.oracle import SF, check, compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(spark, name):
    check(*compare(spark, registry.QUERIES[name], registry.ORACLE[name]))


def test_only_these_have_no_oracle():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"agg_approx"}


def test_sources_that_resolve(spark):
    rows = {r.format: r.available for r in registry.QUERIES["scan_ext"](spark, SF).collect()}
    assert set(rows) == {"parquet", "orc", "csv", "json", "xml", *files.EXTERNAL} and all(files.available(spark, f) for f in files.BUILT_IN)


def test_approximations_are_close(spark):
    rows = {r.event_type: r for r in registry.QUERIES["agg_approx"](spark, SF).collect()}
    exact = spark.sql(f"SELECT event_type, count(DISTINCT user_id) n FROM parquet.`{SF}/events.parquet` GROUP BY 1").collect()
    assert all(abs(rows[r.event_type].users - r.n) <= 0.1 * r.n + 1 for r in exact)
    for r in spark.sql(f"SELECT event_type, median(value) m, percentile(value, array(0.45, 0.55)) e FROM parquet.`{SF}/events.parquet` GROUP BY 1").collect():
        assert r.e[0] <= rows[r.event_type].median <= r.e[1]


def test_pushdown(spark):
    plan = registry.QUERIES["filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_returnflag" not in plan


@pytest.mark.parametrize("name", ["vec_dot_all", "vec_topk_all"])
def test_searches_take_every_query(spark, name, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "ROWS", 7)
    got, want = compare(spark, registry.QUERIES[name], registry.ORACLE[name])
    ids = spark.sql(f"SELECT count(*) FROM parquet.`{SF}/embeddings.parquet` WHERE vec_id % 50 = 0").first()[0]
    check(got, want)
    assert len(got[1]) == 10 * ids and ids > 1


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_has_no_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.QUERIES["join_bucketed"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "hashpartitioning(o_orderkey" not in plan and "hashpartitioning(l_orderkey" not in plan
