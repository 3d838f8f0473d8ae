"""Vectorised Python functions: scalar, grouped, cogrouped, batch and table forms."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def net_price():
    """Scalar pandas UDF."""

    @F.pandas_udf("double")
    def f(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return f


def geometric_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """A user aggregate in two steps: Python sums the logarithms of each batch by key, Spark adds up the sums.

    No group is brought together; a task gives a row for each batch and key.
    """
    kind = df.schema[key].dataType.simpleString()

    def partial(batches):
        for b in batches:
            t = pa.table({"key": b.column(0), "log": pc.ln(b.column(1)), "one": pa.array([1] * b.num_rows, pa.int64())})
            sums = t.group_by("key").aggregate([("log", "sum"), ("one", "sum")])
            yield from sums.select(["key", "log_sum", "one_sum"]).rename_columns(["key", "s", "n"]).combine_chunks().to_batches()

    sums = df.select(key, F.col(value).cast("double")).mapInArrow(partial, f"key {kind}, s double, n long")
    return sums.groupBy(F.col("key").alias(key)).agg(F.exp(F.sum("s") / F.sum("n")).alias("g"))


def demean(df: DataFrame, key: str, value: str, rows: int = 100_000) -> DataFrame:
    """Grouped map: the value less its group's mean, with large groups in parts of about so many rows.

    The mean comes from an aggregation, so a part needs no other part of its group.
    """
    kind = df.schema[key].dataType.simpleString()

    def f(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: g[key], "d": g[value] - g["mean"]})

    means = df.groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias("mean"), F.ceil(F.count("*") / rows).alias("parts"))
    wide = df.select(key, value).join(means, F.col(key).eqNullSafe(F.col("_k"))).withColumn("part", F.floor(F.rand(1) * F.col("parts")))
    return wide.groupBy(key, "part").applyInPandas(f, f"{key} {kind}, d double")


def cogroup_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Cogrouped map: rows of each side by key, from counts that Spark has added up before."""

    def f(x: pa.Table, y: pa.Table) -> pa.Table:
        k = (x if x.num_rows else y)[key][0].as_py()
        n = [t["n"][0].as_py() if t.num_rows else 0 for t in (x, y)]
        return pa.table({"k": pa.array([k], pa.int64()), "n_a": pa.array(n[:1], pa.int64()), "n_b": pa.array(n[1:], pa.int64())})

    l, r = (t.groupBy(F.col(key).cast("long").alias(key)).agg(F.count("*").alias("n")) for t in (a, b))
    return l.groupBy(key).cogroup(r.groupBy(key)).applyInArrow(f, "k long, n_a long, n_b long")


def upper_batches(df: DataFrame, column: str) -> DataFrame:
    """Batch map over Arrow batches."""

    def f(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.utf8_upper(b.column(0))], ["u"])

    return df.select(column).mapInArrow(f, "u string")


def words_table():
    """A Python table function: words of a text with their places."""

    @F.udtf(returnType="pos int, word string")
    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split(" ")):
                yield i, w

    return Words
