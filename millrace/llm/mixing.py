"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each source has a token target. The rates of its documents stay as near to one copy each as the target
allows, in the sense of the bounded (Fermi-Dirac) entropy on 0..CAP: the minimum under the token
constraint is an exponential tilt of the size, rate = CAP / (1 + exp(-lambda * size / mean size)) for
CAP 2, and lambda solves a convex dual. Newton iterations, held in a bracket, solve the duals of all
sources at once; each is one aggregation over the (source, size) histogram, which has the same sums
as the documents.

Rates become whole copies by rounding running totals: sizes in descending order, each (source, size)
group takes the difference of the rounded running copies, so a source's words miss its target by less
than its largest document. Within a group, whose documents weigh the same, the copies over the common
number go to the lowest hashes; large groups are joined by broadcast and cut into blocks by hash for
that, so that a group with a third of all rows is no task's own.

Bounds: the histogram has at most as many rows per source as there are sizes; the table of sources is
put in order in one task.

Defined results: null text: size 0; null source: a source of its own, the last; texts of any length are
counted whole; documents of size 0 take one copy, of no words; ties of size: by a hash of id and text; repeated rows: each counts; empty table: no rows; a target of twice the
source's size: two copies of each; columns beside doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, replaced, written

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
STEPS, CLOSE, SURE, BLOCK = 60, 1e-9, 1e-6, 2000  # SURE: what a share of a target may be missed by at most


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target from rows (source, size, n).

    The sources capped are those of the least size for their weight, so running sums over that order find
    where the resharing ends.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    # Spark compares strings by UTF-8 bytes, which is the order of code points
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    one = by.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # the level at each place, were all before it capped; the first place that isn't capped has the right one
    level = one.withColumn("level", left / open_w)
    free = F.when(F.col("level") * F.col("w") < F.col("most"), F.col("level"))
    final = level.withColumn("final", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most"), F.coalesce(F.col("final") * F.col("w"), F.col("most")))
    return final.select("source", "source_size", "n", target.cast("double").alias("target"))


def _rate(cap: float):
    """The tilted rate of a document of this size."""
    x = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("full"), F.lit(cap)).otherwise(cap / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0)))))


def solve_tilts(histogram: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """targets with mean, full and lam: Newton's steps on every source's dual, one aggregation a step."""
    start = targets.withColumns({
        "mean": F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)),
        "full": (F.col("source_size") > 0) & (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)),
        "low": F.lit(-1e6), "high": F.lit(1e6), "lam": F.lit(0.0), "miss": F.lit(1.0),
    })
    state = written(start, "tilts")
    for _ in range(STEPS):
        rated = histogram.join(state, histogram["s"].eqNullSafe(state["source"]))
        r = _rate(cap)
        x = F.col("size") / F.col("mean")
        sums = rated.groupBy("source").agg(
            F.sum(F.col("k") * F.col("size") * r).alias("got"),
            F.sum(F.col("k") * F.col("size") * r * (1 - r / cap) * x).alias("slope"),
            *[F.first(c).alias(c) for c in ("source_size", "n", "target", "mean", "full", "low", "high", "lam")],
        )
        over = F.col("got") > F.col("target")
        sums = sums.withColumns({
            "low": F.when(over, F.col("low")).otherwise(F.col("lam")),
            "high": F.when(over, F.col("lam")).otherwise(F.col("high")),
            "miss": F.when(F.col("full") | (F.col("source_size") == 0), F.lit(0.0)).otherwise(F.abs(F.col("got") - F.col("target")) / F.col("target")),
        })
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(F.col("miss") <= CLOSE, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = replaced(state, sums.withColumn("lam", step).select(state.columns), "tilts")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= CLOSE:
            break
    else:
        if state.agg(F.max("miss")).first()[0] > SURE:
            raise RuntimeError(f"the tilts did not come within {SURE} of their targets in {STEPS} steps")
    # nine digits, so that the order of summation cannot change a rerun
    return state.withColumn("lam", F.round("lam", 9))


def n_words(text: Column) -> Column:
    """How many words of WORD's pattern a text has (null: 0), without a list of them, which for a long text would be many times its size.

    Each word becomes one byte and takes the white space before it along; what is left at the end is trimmed.
    """
    ones = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")
    return F.coalesce(F.octet_length(F.rtrim(ones, F.lit(" \t\n\v\f\r"))), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of docs."""
    # of rows equal in id, source and size the salt of the text tells which takes a copy more
    rows = written(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")), "sizes")
    histogram = written(rows.groupBy("source", "size").agg(F.count("*").alias("k")).withColumnRenamed("source", "s"), "histogram")
    targets = source_targets(histogram.select(F.col("s").alias("source"), "size", F.col("k").alias("n")), weights, share, cap)
    tilts = solve_tilts(histogram, targets, cap)
    rated = histogram.join(tilts, histogram["s"].eqNullSafe(tilts["source"])).withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(cap)))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.floor(F.round(F.sum(F.col("rate") * F.col("k")).over(down), 6) + 0.5)
    groups = rated.withColumn("running", running).withColumn("last", F.lag("running").over(Window.partitionBy("source").orderBy(F.col("size").desc())))
    copies = F.col("running") - F.coalesce("last", F.lit(0))
    most = F.least(F.greatest(copies, F.lit(0)), F.col("k") * int(cap))
    groups = groups.select(
        F.col("s").alias("g_source"), F.col("size").alias("g_size"), "source_size", "target", "rate",
        F.floor(most / F.col("k")).alias("each"), (most % F.col("k")).alias("extra"),
        F.ceil(F.col("k") / BLOCK).alias("blocks"), "k",
    )
    groups = written(groups, "groups")
    placed = join_skewed(rows, groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")), "k", rows.count())
    placed = placed.withColumn("block", F.pmod("h", "blocks"))
    key = ["g_source", "g_size", "block"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("here"))
    up_to = Window.partitionBy("g_source", "g_size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("here").over(up_to), F.lit(0)))
    # only groups of several blocks need their places before; they are few and the rest join nothing
    first = first.where("block > 0").select(F.col("g_source").alias("f_source"), F.col("g_size").alias("f_size"), F.col("block").alias("f_block"), "first")
    placed = placed.join(first, placed["g_source"].eqNullSafe(first["f_source"]) & (placed["g_size"] == first["f_size"]) & (placed["block"] == first["f_block"]), "left")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id")) + F.coalesce("first", F.lit(0))
    number = F.col("each") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    out = placed.withColumn("copies", number.cast("long"))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
