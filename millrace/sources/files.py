"""Sources and sinks by format, behind one pair of functions."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

#: Formats that Spark itself reads and writes.
BUILT_IN = ("parquet", "orc", "csv", "json", "text", "xml", "binaryFile")
#: Formats of external packages.
EXTERNAL = ("avro", "kafka", "delta", "iceberg")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A lazily read table; give a schema for text formats, as inferring one reads the data twice."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None, **options) -> None:
    """Writes a table, partitioned by columns if given."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def available(spark: SparkSession, fmt: str) -> bool:
    """Whether the session can resolve a data source."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(fmt, spark._jsparkSession.sessionState().conf())
    except Exception:  # noqa: BLE001  Spark throws one of several kinds for a missing source
        return False
    return True


BUCKET = 128 << 20  # bytes of a bucket


def buckets_for(*tables: DataFrame, most: int = 100_000) -> int:
    """How many buckets of BUCKET bytes hold the largest of these tables, by Spark's estimate of their sizes; a power of two."""
    size = max(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, size / BUCKET)))))


def write_bucketed(df: DataFrame, by: list[str], buckets: int, table: str | None = None) -> DataFrame:
    """A table written in buckets and read back: joins and aggregations on the columns need no shuffle.

    Rows are dealt out by the columns before, so that each bucket is one file. Without a name it is a table of this session,
    whose files go with the driver and whose entry goes with the session, or with the driver where that is still open.
    """
    name = table or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).mode("overwrite")
    (writer if table else writer.option("path", scratch(df.sparkSession, name))).saveAsTable(name)
    if not table:
        atexit.register(_drop, df.sparkSession, name)
    return df.sparkSession.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
