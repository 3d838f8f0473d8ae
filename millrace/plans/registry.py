"""All core queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def sql(name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
    """Registers a plan written as Spark SQL; oracle defaults to the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(spark_sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = oracle or spark_sql


sql(
    "pricing_summary",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price,
       avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
       GROUP BY l_returnflag, l_linestatus""",
)
