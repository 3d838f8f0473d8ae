"""Grouped operators: top rows of groups, two-stage aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Catalyst turns the filter into a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def salted_count_distinct(df: DataFrame, by: list[str], column: str, salts: int = 32) -> DataFrame:
    """count(DISTINCT column) by group in two stages, so that a hot group is spread by its values."""
    salt = F.pmod(F.xxhash64(column), F.lit(salts))
    first = df.groupBy(*by, salt.alias("_salt")).agg(F.count_distinct(column).alias("_n"))
    return first.groupBy(*by).agg(F.sum("_n").alias("n_distinct"))


def percentile(df: DataFrame, by: list[str], value: str, q: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """The exact interpolated percentile of each group, without bringing a group together.

    A mergeable sketch gives two values between which the percentile must lie, as its rank error is at most
    a share of 1 / accuracy; the rows between them are counted by value, those below in one number, and
    the rank is found among these few. Groups of up to 2 * accuracy rows are counted by value as a whole.
    Nulls don't count; a group of nulls alone has a null percentile.
    """
    wide = 4.0 / accuracy
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", [0.0, max(0.0, q - wide), min(1.0, q + wide), 1.0], accuracy)
    groups = rows.groupBy(*by).agg(ends.alias("_ends"), F.count("_v").alias("_n"))
    pick = lambda few, many: F.when(F.col("_n") <= 2 * accuracy, F.col("_ends")[few]).otherwise(F.col("_ends")[many])
    groups = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by], pick(0, 1).alias("_from"), pick(3, 2).alias("_to"), "_n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = rows.join(groups, same).where((F.col("_v") <= F.col("_to")) | (F.col("_n") == 0))
    kept = met.groupBy(*by, "_n", F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_x")).agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first()))
    at = (F.col("_n") - 1) * F.lit(q)
    reached = lambda rank: F.min(F.when(F.col("_up") > rank, F.col("_x")))
    found = kept.withColumn("_up", up_to).groupBy(*by, "_n").agg(reached(F.floor(at)).alias("_low"), reached(F.ceil(at)).alias("_high"))
    return found.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))).alias(name))
