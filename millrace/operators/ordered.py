"""Windows over a whole table in one order, and sessions of hot keys: range partitions and scans over one row of each, so no single task.

A table is put in order by ranges. A row's number is its place within its partition and the rows of the partitions before it. By
their numbers rows form blocks of exactly SIZE, whatever their values: what a row needs of its neighbours is copied over a block's
border, and what it needs of all rows before it is the scan over one row a block, which is done in the same way again.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SIZE, ROWS = 1 << 14, 1 << 16  # rows of a block, of a partition; at most PARTS partitions, one row of each goes to the driver
PARTS = 1 << 14
PLACE = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count within a partition


def by(order: list[str]) -> list[Column]:
    """Sort columns of names, each with DESC after it where that is meant; nulls first, or last where descending, as in Spark."""
    return [F.col(n).desc() if way.strip().upper() == "DESC" else F.col(n).asc() for n, _, way in (o.partition(" ") for o in order)]


def numbered(df: DataFrame, order: list[str], name: str = "rn", rows: int | None = None) -> DataFrame:
    """df with the number of each row in this order, from 1, stored.

    One shuffle by ranges of the order; a hash of the row splits ranges of ties, among which the order is open, so only rows that
    repeat in all columns stay together. Partitions hold about `rows` rows, but there are PARTS of them at most.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name}")
    ties = F.xxhash64(*[f.name for f in df.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    n = min(PARTS, max(1, math.ceil(df.count() / (rows or ROWS))))
    put = df.repartitionByRange(n, *by(order), ties).sortWithinPartitions(*by(order), ties)
    held = stored(put.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r.p: r.n for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    starts = df.sparkSession.createDataFrame(list(before.items()), "_p int, _start long")
    # PARTS rows at most
    return held.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(PLACE)) + 1).drop("_at", "_p", "_start")


def framed(rows: DataFrame, number: str, columns: dict[str, tuple[Column, int, int]], size: int | None = None) -> DataFrame:
    """rows, numbered from 1, with aggregates over frames of rows: name -> (aggregate, first, last), counted from each row as in rowsBetween.

    Rows at a block's ends are copied to the neighbours' blocks, as far as frames reach; blocks are as large as frames at least.
    """
    preceding, following = max([0, *(-a for _, a, _ in columns.values())]), max([0, *(b for _, _, b in columns.values())])
    size = max(size or SIZE, preceding, following)
    block, place = F.floor((F.col(number) - 1) / size), (F.col(number) - 1) % size
    to = F.array_compact(F.array(block, F.when(place >= size - preceding, block + 1), F.when((place < following) & (block > 0), block - 1)))
    spread = rows.withColumn("_block", F.explode(to))
    w = Window.partitionBy("_block").orderBy(number)
    out = spread.withColumns({name: c.over(w.rowsBetween(a, b)) for name, (c, a, b) in columns.items()})
    return out.where(F.col("_block") == block).drop("_block")


def running(rows: DataFrame, number: str, columns: dict[str, tuple[str, str]], size: int | None = None) -> DataFrame:
    """rows, numbered from 1, with running aggregates from the first row on: name -> (sum, min, max or count, column).

    Blocks' totals are a table of one row a block, which is scanned by this function itself until one block is left.
    """
    size = max(2, size or SIZE)
    make = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}
    block = F.floor((F.col(number) - 1) / size).cast("long")
    held = rows.withColumn("_block", block)
    w = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumns({name: make[how](c).over(w) for name, (how, c) in columns.items()})
    last = rows.agg(F.max(number)).first()[0] or 0
    if last <= size:
        return inside.drop("_block")
    totals = held.groupBy("_block").agg(*[make[how](c).alias(name) for name, (how, c) in columns.items()])
    totals = stored(totals.withColumn("_n", F.col("_block") + 1), "totals")
    names = {name: f"_{name}_before" for name in columns}
    scanned = running(totals, "_n", {names[name]: ("sum" if how == "count" else how, name) for name, (how, _) in columns.items()}, size)
    before = scanned.select(F.col("_n").alias("_block"), *names.values())  # what a block's rows have before them stands with the block before
    out = inside.join(before, "_block", "left")
    return out.withColumns({name: join[how](F.col(names[name]), F.col(name)) for name, (how, _) in columns.items()}).drop("_block", *names.values())


def ranked(df: DataFrame, order: list[str], ties: list[str] = (), rows: int | None = None, size: int | None = None) -> DataFrame:
    """df with rn, its row_number by order and ties, and r and dr, its rank and dense_rank by order, over the whole table.

    A row begins a rank if its order differs from that of the row before: a frame of one row. Ranks are then running
    maxima and sums. Nulls are equal to each other, as in SQL.
    """
    keys = [o.partition(" ")[0] for o in order]
    rn = numbered(df, [*order, *ties], "rn", rows)
    seen = framed(rn, "rn", {"_prior": (F.first(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])), -1, -1)}, size)
    new = F.col("rn") == 1
    for i, k in enumerate(keys):
        new |= ~F.col(k).eqNullSafe(F.col(f"_prior.k{i}"))
    flagged = seen.withColumns({"_begins": F.when(new, F.col("rn")), "_new": new.cast("long")})
    return running(flagged, "rn", {"r": ("max", "_begins"), "dr": ("sum", "_new")}, size).select(*df.columns, "rn", "r", "dr")


def sessions(df: DataFrame, key: str, time: str, seconds: int, bucket: str = "day") -> DataFrame:
    """key, start_ts, end_ts, n: sessions of each key, which end where no row follows within so many seconds.

    Rows are grouped by key and bucket of time, so a hot key has a task for each bucket. Within one, sessions are those of its rows alone;
    of these only the first and the last can go on over a border. They are put together by a scan over two rows a bucket at
    most, and the others stay as they are. A row exactly `seconds` after the last one goes on with its session.

    Null keys are a key of their own, rows with a null time belong to no session, rows that repeat each count.
    """
    gap = F.make_dt_interval(secs=F.lit(seconds))
    rows = df.select(F.col(key).alias("k"), F.col(time).alias("t")).where("t IS NOT NULL").withColumn("b", F.date_trunc(bucket, "t"))

    def chained(parts: DataFrame, keys: list[str], keep: list[Column]) -> DataFrame:
        """Parts (start, last, n) of one session put together: those that follow the one before within the gap."""
        w = Window.partitionBy(*keys).orderBy("start", "last")
        fresh = F.when(F.col("start") <= F.lag("last").over(w) + gap, 0).otherwise(1)
        own = parts.withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return own.groupBy(*keys, "s").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), *keep)

    # rows of one time are one part, so a key's bucket has as many as it has different times
    parts = rows.groupBy("k", "b", "t").agg(F.count("*").alias("n")).select("k", "b", F.col("t").alias("start"), F.col("t").alias("last"), "n")
    local = chained(parts, ["k", "b"], [])
    ends = Window.partitionBy("k", "b")
    local = stored(local.withColumn("edge", (F.col("s") == 1) | (F.col("s") == F.max("s").over(ends))), "sessions")
    merged = chained(local.where("edge"), ["k"], [])
    out = merged.select("k", "start", "last", "n").unionByName(local.where("NOT edge").select("k", "start", "last", "n"))
    return out.select(F.col("k").alias(key), F.col("start").alias("start_ts"), (F.col("last") + gap).alias("end_ts"), "n")
