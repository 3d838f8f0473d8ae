"""Joins that Spark has no syntax or no good strategy for, as compositions of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .inequality import inequality_join


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, value: list[str], prefix: str = "asof_", bucket: str = "day") -> DataFrame:
    """Each left row with the columns `value` of the latest right row of the same keys at or before its time.

    Both sides are tagged, united and dealt out by key and bucket of time, so a hot key has a task for each
    bucket. Within a bucket a running last_value carries the right row on; what a bucket starts with comes
    from a scan over one row a bucket, the last right row of each. Of right rows of one time the greatest counts.
    """
    keep = left.columns
    tagged = left.withColumns({"_side": F.lit(1), "_right": F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType)})
    other = right.select(*by, time, F.lit(0).alias("_side"), F.struct(*value).alias("_right"))
    both = tagged.unionByName(other, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, time))
    ends = both.groupBy(*by, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct(time, "_right"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(before)["_right"].alias("_start"))
    w = Window.partitionBy(*by, "_bucket").orderBy(time, "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("_latest", F.last_value("_right", F.lit(True)).over(w)).where("_side = 1")
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"), "_start")
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = F.coalesce("_latest", "_start")
    return latest.join(starts, same, "left").select(*keep, *[found[v].alias(prefix + v) for v in value])


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, seconds: int) -> DataFrame:
    """Rows of equal keys `by` with at <= other <= at + seconds, for columns whose names differ but for `by`.

    An equi join on keys and time buckets of that length: a left row stands in its own bucket and the next, a
    right row in its own alone, so a hot key is split by time and no pair is met twice.
    """
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    l = left.withColumn("_b", F.explode(F.array(number(at), number(at) + 1)))
    r = right.withColumn("_b", number(other))
    end = F.col(at) + F.make_dt_interval(secs=F.lit(seconds))
    return l.join(r, [*by, "_b"]).where((F.col(other) >= F.col(at)) & (F.col(other) <= end)).drop("_b")


WIDE = 64  # buckets of a range at most


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= at < high, as an equi join on buckets of `width` instead of a product.

    A right row stands in every bucket its range meets; the exact condition is applied after. Ranges of more than WIDE buckets would
    make rows without a bound: those go through the join on two inequalities, for which columns of the sides differ in name.
    Nulls match nothing, as does an empty or turned range.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    ranges, is_wide = right.where(F.col(low) < F.col(high)), (F.col(high).cast("double") - F.col(low).cast("double")) / width >= WIDE
    tagged = ranges.where(~is_wide).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    on = (bucket(at) == F.col("_b")) & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    found = left.join(tagged, on).drop("_b")
    wide = ranges.where(is_wide)
    return found if wide.isEmpty() else found.unionByName(inequality_join(left, wide, (at, ">=", low), (at, "<", high)))


HOT = 4096  # a key with a HOT-th of all left rows is hot


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner join whose hot left keys are spread over `salts` tasks each.

    Keys are counted first; HOT of them at most are hot and go to all tasks. Only their rows of the right side are repeated, the
    others' are joined as they are. Null keys match nothing.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = stored(counts.where(F.col("_n") * HOT >= left.count()).select(*on, F.lit(salts).alias("_salts")), "hot")
    marked = lambda df: df.join(F.broadcast(hot), on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    l = marked(left).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_salts")).cast("int"))
    r = marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return l.drop("_salts").join(r.drop("_salts"), [*on, "_salt"]).drop("_salt")
