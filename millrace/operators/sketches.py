"""Stored sketches: mergeable columns for distinct counts and quantiles, written by day and merged over any range later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 400  # registers of a distinct count: relative error of 1.04 / 2 ** (LG_K / 2); of a quantile sketch: rank error of about 0.7 %


def sketched(df: DataFrame, by: list[str], time: str, distinct: str, value: str, unit: str = "day") -> DataFrame:
    """by, period, n, users, quantiles: one row of sketches for each group and period, of a few kilobytes whatever the rows.

    Partial sketches are built where the rows are and merged, so no group comes together. Null values are in neither sketch, null times are a
    period of their own, and n counts all rows; a group of nulls alone has empty sketches.
    """
    rows = df.select(*by, F.date_trunc(unit, time).cast("timestamp_ntz").alias("period"), F.col(distinct).alias("_d"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy(*by, "period").agg(F.count("*").alias("n"), F.hll_sketch_agg("_d", LG_K).alias("users"), F.kll_sketch_agg_double("_v", K).alias("quantiles"))


def merged(sketches: DataFrame, by: list[str], within: Column | None = None) -> DataFrame:
    """by, n, users, quantiles: the sketches of all periods within a range put together, as if they had been made of all their rows at once."""
    some = sketches if within is None else sketches.where(within)
    return some.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("quantiles", K).alias("quantiles"))


def distinct_count(users: str = "users") -> Column:
    return F.hll_sketch_estimate(users)


def quantile(q: float, quantiles: str = "quantiles") -> Column:
    """A value whose rank is within about 1 % of q; null of an empty sketch."""
    return F.when(F.kll_sketch_get_n_double(quantiles) > 0, F.kll_sketch_get_quantile_double(quantiles, F.lit(q)))
