"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds: each round hangs the neighbours of a node on the least
node among them, and a few rounds turn every component into a star. State is a table of links in the
shared folder, written each round in place of the last; the driver sees counts alone. A node with a large
share of all links, as the middle of a star, takes its least neighbour by broadcast: its links stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, replaced, written


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable."""
    e = written(_star(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    last, size = None, e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        # large star: neighbours above u hang on the least of u and its neighbours
        large = join_skewed(both.where("v > u"), low, F.col("u") == F.col("w"), "n", 2 * size)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: neighbours below u, and u, hang on the least of them
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = replaced(e, _star(small), "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last, size = tuple(state), state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _star(e: DataFrame) -> DataFrame:
    return e.where("u <> v").distinct()
