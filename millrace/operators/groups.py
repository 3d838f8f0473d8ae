"""Groups of similar sets: links that span each group, and who belongs to it, without all pairs of a large group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove, stored
from . import sets

SMALL, HOT, ROUNDS = 32, 4096, 60  # rows of a group that are all compared; a key with a HOT-th of all rows is hot; rounds at most


def _replaced(old: DataFrame, new: DataFrame, what: str) -> DataFrame:
    """new, stored, after which what old was read from goes."""
    out = stored(new, what)
    for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        remove(old.sparkSession, path)
    return out


def to_one(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table of unique keys, which says in `count` how many rows have each.

    Keys with a HOT-th of the total are HOT at most: those are broadcast, so that their rows stay where they are.
    """
    hot = F.col(count) * HOT >= total
    few = F.broadcast(table.where(hot))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(table.where(~hot), on))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link: the least node that it reaches.

    Rounds of large and small stars: neighbours above a node, then those below, hang on the least that the node knows, until nothing
    changes, which takes few rounds whatever a component's size or shape. Each round is a table in the shared folder.
    """
    star = lambda e: e.where("u <> v").distinct()
    e = stored(star(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    state = None
    for _ in range(ROUNDS):
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = star(to_one(both.where("v > u"), low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = to_one(large, least, ["u"], "n", n)
        hung = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = _replaced(e, star(small.select(F.explode(hung).alias("x")).select("x.*")), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _bands(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """(id, band, k): the MinHash bands of each set of 64-bit hashes."""
    salts = np.random.default_rng(0).integers(0, 1 << 63, bands * width).astype(np.uint64) | np.uint64(1)

    def run(batches):
        for b in batches:
            x, ends = sets.ragged(b.column(1))
            begin, x = ends - np.diff(ends, prepend=0), x.astype(np.uint64)
            for j in range(bands):
                k = np.zeros(len(ends), np.uint64)
                for salt in salts[j * width : (j + 1) * width]:
                    y = x * salt
                    k = (k ^ np.minimum.reduceat(y ^ y >> np.uint64(29), begin)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ends), j, np.int32)), pa.array(k.astype(np.int64))], ["id", "band", "k"])

    return rows.select("id", "s").mapInArrow(run, "id long, band int, k long")


def _copies(rows: DataFrame, found: DataFrame, least: float, bands: int, width: int) -> DataFrame:
    """Links of the rows of bands' groups of over SMALL rows with the least of their group, its hub, if they are similar."""
    every = stored(_bands(rows, bands, width), "bands")
    group = every.groupBy("band", "k").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where(F.col("n") > SMALL)
    own = to_one(every, stored(group, "groups"), ["band", "k"], "n", every.count()).where("id <> hub")
    return sets.verified(own.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), rows, found).where(_similar(least))


def _similar(least: float) -> Column:
    return F.col("shared") >= (least - 1e-9) * F.col("united")


def _across(found: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b) of the sets that can be similar, but not of those of one root. An item's rows of its most frequent root meet the others alone."""
    rows = sets.postings(found.join(roots.select(F.col("node").alias("id"), "root"), "id", "left"), "root")
    held = rows.where("root IS NOT NULL").groupBy("token", "root").agg(F.count("*").alias("m"))
    most = held.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("most"))
    own = rows.join(most, "token", "left").withColumn("usual", F.coalesce(F.col("root") == F.col("most"), F.lit(False)))
    met = sets.side(own.where("NOT usual"), "a", "root").join(sets.side(own, "b", "root", "usual"), "token")
    met = met.where("(b_usual OR a < b) AND NOT coalesce(a_root = b_root, false)")
    return sets.likely(met, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def spanning_links(df: DataFrame, key: str, items: str, least: float, bands: int = 20, width: int = 4) -> DataFrame:
    """a, b, shared, united: pairs a < b of rows whose sets have a Jaccard similarity of least or more, enough of them to connect all that are.

    First, near copies: rows that agree in all MinHashes of a band, if they are over SMALL, are compared with the least of them, their hub, and those
    that are similar hang on it. Then all pairs that can be similar are compared, as in `sets`, but for those that hang together already.
    Thus no pair's connection is lost, and a group of n near copies is n comparisons a band at most.

    Hubs of hot groups are broadcast, HOT at most. Keys are whole numbers, unique and not null; null and empty sets are similar to nothing; items that
    repeat count once; an empty table gives no rows. df is read for each step.
    """
    rows = sets.hashed(df, key, items).withColumn("id", F.col("id").cast("long"))
    found = sets.prefixes(rows, least)
    copies = stored(_copies(rows, found, least, bands, width), "copies")
    pairs = sets.candidates(found, least) if copies.isEmpty() else _across(found, components(copies, "a", "b"), least)
    rest = sets.verified(pairs, rows, found).where(_similar(least))
    return stored(copies.unionByName(rest), "links")


def similar_groups(df: DataFrame, key: str, items: str, least: float, **bands: int) -> DataFrame:
    """key and group_id of each row with a key: the least key that it reaches over similar sets, or its own."""
    roots = components(spanning_links(df, key, items, least, **bands), "a", "b")
    found = df.select(key).where(F.col(key).isNotNull()).join(roots, F.col(key) == F.col("node"), "left")
    return found.select(key, F.coalesce("root", key).alias("group_id"))
