"""Recursion beyond what Spark's WITH RECURSIVE takes."""

import __spark_entry__ as entry


def test_more_rows_than_the_limit_of_spark(spark, tmp_path):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.range(300).selectExpr("id AS c_custkey", "CAST(id % 7 AS DOUBLE) - 2.5 AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    try:
        spark.conf.set(limit, "50")
        got = {r.k: (r.depth, r.total) for r in entry.queries()["cte_recursive"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(limit, before)
    want = {1: (0, -2)}
    for k in range(2, 300):
        depth, total = want[k // 2]
        want[k] = depth + 1, total + k % 7 - 3
    assert got == want
