"""Hard negatives by product quantisation with stored residual norms.

Components become whole numbers, so every score is exact. Codebooks of whole-number centroids, one for each SUB
components, are fitted on a bounded sample; the index holds every row: a byte for each codebook, the norm of
what the codes leave over, and the components. An anchor's score with a row lies within |anchor| * |residual| of the
sum that the lookup tables give (Cauchy-Schwarz), so a window of scores is searched in three steps: tables for all
rows, bounds that leave those that can be among the best of the window, exact integer scores for these. The
bounds are rigorous and every row is in the index, so recall is 1; tests hold it against brute force.

1. An anchor's positives: the best rows of its label, from blocks of rows of that label.
2. For each of their scores the window from LOW hundredths of it up to it: the best rows of other labels within.

Anchors are the stated query set, searched against all rows in blocks: a block of rows meets each block of anchors once a
pass, by an equi join on a number that anchors are repeated for, and gives at most k rows an anchor and window. That join is never a
broadcast, as Spark estimates it without the repeats; anchors are repeated to half as many as there are rows, or for LEAST groups.

Bounds: the sample is FIT_ROWS rows of the lowest hashes, its codebooks 256 centroids each, which is all that the
driver holds; a pair of blocks takes ANCHORS x ROWS x 8 bytes a few times over; anchors are never gathered. Work grows with
anchors times rows, at a table lookup for each SUB components.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors are
filled up with zeros, so an empty vector scores 0 with all; a null id is no anchor, no multiple of anything, and comes last
among ties; rows of the anchor's own id are never its positives; a repeated anchor counts once, other repeated rows each, so they take a
rank each; anchors that share an id with other content are searched each; an anchor without positives or a window without rows gives
no row; a positive score below zero has an empty window; ids and labels are whole numbers below the greatest long; components so large that scores may
leave 62 bits are an error; empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, parts, written

SCALE, SUB, CENTROIDS, FIT_ROWS, FIT_STEPS = 256, 2, 256, 4096, 6
ROWS, ANCHORS = 8192, 256  # of a block
LEAST = 16  # groups of blocks that anchors may be repeated for, whatever they take
PAIRS = 1 << 16  # exact scores computed at a time
LOW, POSITIVES, NEGATIVES = 80, 5, 5
LAST = np.iinfo(np.int64).max  # what a null id counts as

BLOCK = "ids binary, keys binary, labels binary, codes binary, norms binary, data binary"


def components(x, width: int) -> np.ndarray:
    """floor(SCALE * x) of a list of vectors, filled up with zeros to `width`."""
    flat = np.floor(SCALE * np.array(x.flatten().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    length = np.array(x.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(x), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def fit(sample: np.ndarray) -> np.ndarray:
    """Codebooks (codebook, centroid, component) of whole numbers by Lloyd's steps; fewer rows repeat centroids."""
    m = sample.shape[1] // SUB
    books = np.zeros((m, CENTROIDS, SUB), np.int64)
    for j in range(m if len(sample) else 0):
        x = sample[:, j * SUB : (j + 1) * SUB].astype(np.float64)
        # rows in order of the first component, at even steps
        c = x[np.lexsort(x.T)[np.linspace(0, len(x) - 1, CENTROIDS).round().astype(int)]]
        for _ in range(FIT_STEPS):
            own = nearest(x, c)
            count = np.bincount(own, minlength=CENTROIDS)
            for s in range(SUB):
                total = np.bincount(own, x[:, s], CENTROIDS)
                c[:, s] = np.where(count > 0, total / np.maximum(count, 1), c[:, s])
        books[j] = np.round(c)
    return books


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; any would do, as residuals are taken from the one that is stored."""
    return np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the residuals, rounded up)."""
    m = books.shape[0]
    codes, left = np.zeros((len(x), m), np.uint8), np.zeros(len(x), np.int64)
    for j in range(m):
        own = x[:, j * SUB : (j + 1) * SUB]
        codes[:, j] = nearest(own.astype(np.float64), books[j].astype(np.float64))
        left += ((own - books[j][codes[:, j]]) ** 2).sum(1)
    return codes, root_up(left)


def root_up(x: np.ndarray) -> np.ndarray:
    """The least whole number whose square is x or more."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r += r * r < x
    return r + (r * r < x)


class Block:
    """Rows of a block as arrays; anchors have no codes."""

    def __init__(self, ids: bytes, keys: bytes, labels: bytes, codes: bytes, norms: bytes, data: bytes):
        self.ids, self.keys, self.labels, self.norms = (np.frombuffer(b, np.int64) for b in (ids, keys, labels, norms))
        n = len(self.ids)
        self.codes, self.data = np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(data, np.int64).reshape(n, -1)


def blocks(rows: DataFrame, size: int, width: int, books: np.ndarray | None) -> DataFrame:
    """Blocks of up to size rows (id, key, label, vector); with books, their codes and residual norms."""

    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some).combine_chunks()
        x = components(t.column("vector").combine_chunks(), width)
        codes, norms = encode(x, books) if books is not None else (np.zeros(0, np.uint8), root_up((x**2).sum(1)))
        ids, keys, labels = (np.array(t.column(c).to_numpy(), np.int64) for c in ("id", "key", "label"))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, keys, labels, codes, norms, x)], ["ids", "keys", "labels", "codes", "norms", "data"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return rows.select("id", "key", "label", "vector").mapInArrow(run, BLOCK)


def bounds(q: Block, a: np.ndarray, r: Block, b: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) tables of the least and the greatest score that anchors a can have with rows b."""
    x = q.data[a].reshape(len(a), books.shape[0], SUB)
    est = np.zeros((len(b), len(a)), np.int64)
    for j in range(books.shape[0]):
        est += (books[j] @ x[:, j].T)[r.codes[b, j]]  # the table of a codebook: a row for each centroid
    est, slack = est.T.copy(), q.norms[a][:, None] * r.norms[b][None]
    return est - slack, est + slack


def exact(q: Block, a: np.ndarray, r: Block, b: np.ndarray) -> np.ndarray:
    """Scores of the pairs (a, b), PAIRS at a time."""
    some = [np.einsum("ij,ij->i", q.data[a[i : i + PAIRS]], r.data[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *some])


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, by score, then id."""
    p = np.lexsort((ids, -score, group))
    first = np.flatnonzero(np.append(True, group[p][1:] != group[p][:-1])[: len(p)])
    place = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    return p[place < k]


def positives(q: Block, r: Block, books: np.ndarray, k: int) -> list[np.ndarray]:
    """[anchor, row, score]: the k best rows of the anchor's label in this block."""
    found = [np.zeros((3, 0), np.int64)]
    for label in np.intersect1d(q.labels, r.labels):
        a, b = np.flatnonzero(q.labels == label), np.flatnonzero(r.labels == label)
        low, high = bounds(q, a, r, b, books)
        own = q.ids[a][:, None] == r.ids[b][None]
        low[own] = high[own] = -LAST
        least = np.partition(low, -k, axis=1)[:, -k] if len(b) >= k else np.full(len(a), -LAST)
        i, j = np.nonzero((high >= least[:, None]) & ~own)
        score = exact(q, a[i], r, b[j])
        p = best(i, score, r.ids[b[j]], k)
        found.append(np.stack([a[i[p]], b[j[p]], score[p]]))
    return list(np.concatenate(found, axis=1))


def negatives(q: Block, scores: list[np.ndarray], r: Block, books: np.ndarray, low_share: int, k: int) -> list[np.ndarray]:
    """[anchor, row, positive score, score]: the k best rows of other labels in each window of an anchor's scores."""
    found = [np.zeros((4, 0), np.int64)]
    for label in np.unique(q.labels):
        a, b = np.flatnonzero(q.labels == label), np.flatnonzero(r.labels != label)
        if not len(b):
            continue
        low, high = bounds(q, a, r, b, books)
        for i, anchor in enumerate(a):
            for top in scores[anchor].tolist():
                least = -(-low_share * top // 100)
                can = (high[i] >= least) & (low[i] <= top)
                # what surely lies in the window sets what the others must reach
                sure = low[i][can & (low[i] >= least) & (high[i] <= top)]
                if len(sure) >= k:
                    can &= high[i] >= np.partition(sure, -k)[-k]
                own = b[can]
                score = exact(q, np.full(len(own), anchor), r, own)
                own, score = own[(score >= least) & (score <= top)], score[(score >= least) & (score <= top)]
                p = best(np.zeros(len(own), np.int8), score, r.ids[own], k)
                found.append(np.stack([np.full(len(p), anchor), own[p], np.full(len(p), top), score[p]]))
    return list(np.concatenate(found, axis=1))


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """Of n rows those of the lowest hashes, twice FIT_ROWS about, so that not every split sorts and sends FIT_ROWS of its own."""
    share = 2 * FIT_ROWS / max(1, n)
    return rows if share > 0.5 else rows.where(F.xxhash64("id", "key") < F.lit(int(2.0**64 * share) - 2**63))


def _pairs(anchors: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """Each block of anchors beside each block of the index, by an equi join: anchors are repeated for n groups of blocks."""
    group = F.pmod(F.xxhash64("ids"), F.lit(n)).alias("g")
    own = index.select(group, *[F.col(c).alias(f"r_{c}") for c in index.columns]).hint("merge")
    return own.join(anchors.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), "g")


def _searched(pairs: DataFrame, kernel, ddl: str, names: list[str], extra: list[str]) -> DataFrame:
    columns = BLOCK.replace(" binary", "").split(", ")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q, r = Block(*(row[c] for c in columns)), Block(*(row[f"r_{c}"] for c in columns))
                a, p, *numbers = kernel(q, r, *(row[c] for c in extra))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q.ids[a], q.keys[a], r.ids[p], *numbers)], names)

    return pairs.mapInArrow(run, ddl)


def mine(rows: DataFrame, is_anchor: Column, low: int = LOW, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (id, label, vector)."""
    spark = rows.sparkSession
    bound_batches(spark)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.col("vector").cast("array<double>")
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), x.alias("vector")).where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(fine).withColumn("key", F.xxhash64("label", "vector"))
    greatest = F.max(F.array_max(F.transform("vector", F.abs)))
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    asking = F.count_if(F.coalesce(is_anchor, F.lit(False)))
    n, n_anchors, width, most = rows.agg(F.count("*"), asking, F.max(F.size("vector")), greatest).first()
    width = -(-max(width or 0, 1) // SUB) * SUB
    if 100 * width * (SCALE * (most or 0.0) + 1) ** 2 >= 2.0**62:
        raise ValueError(f"components of up to {most} give scores beyond 62 bits")
    sample = _lowest(rows, n).orderBy(F.xxhash64("id", "key"), "id", "key").limit(FIT_ROWS).select("vector").toArrow()
    books = fit(components(sample["vector"].combine_chunks(), width))
    held = spark.sparkContext.broadcast(books)

    named = rows.withColumn("id", F.coalesce("id", F.lit(int(LAST))))
    index = written(blocks(named, ROWS, width, books), "codes")
    groups = max(1, min(-(-n // ROWS), parts(rows), max(LEAST, n // (2 * max(1, n_anchors)))))
    anchors = anchors.select("id", "key", "label", "vector").dropDuplicates(["id", "key"])
    asked = written(blocks(anchors, ANCHORS, width, None), "anchors")

    ddl = "anchor_id long, key long, positive_id long, positive_score long"
    names = ["anchor_id", "key", "positive_id", "positive_score"]
    near = _searched(_pairs(asked, index, groups), lambda q, r: positives(q, r, held.value, n_positives), ddl, names, [])
    by = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    near = written(near.withColumn("n", F.row_number().over(by)).where(F.col("n") <= n_positives).drop("n"), "positives")

    # the windows of an anchor go with its vector; blocks are built anew, as anchors without a window need no search
    windows = near.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    wide = anchors.join(windows, ["id", "key"]).select("id", "key", "label", "vector", "tops")
    asked = written(_with_windows(wide, width), "windows")
    ddl = "anchor_id long, key long, negative_id long, positive_score long, negative_score long"
    names = ["anchor_id", "key", "negative_id", "positive_score", "negative_score"]

    def search(q, r, tops, counts):
        ends = np.cumsum(np.frombuffer(counts, np.int64))
        return negatives(q, np.split(np.frombuffer(tops, np.int64), ends[:-1]), r, held.value, low, n_negatives)

    far = _searched(_pairs(asked, index, groups), search, ddl, names, ["tops", "counts"])
    by = Window.partitionBy("anchor_id", "key", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    known = lambda c: F.nullif(c, F.lit(int(LAST))).alias(c)
    out = near.join(far, ["anchor_id", "key", "positive_score"])
    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def _with_windows(anchors: DataFrame, width: int) -> DataFrame:
    """Blocks of anchors with the ends of their windows, one after the other, and their numbers."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ANCHORS):
                t = b.slice(at, ANCHORS)
                x, tops = components(t.column("vector"), width), t.column("tops")
                ids, keys, labels = (np.array(t.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("id", "key", "label"))
                ends, counts = (np.array(v.to_numpy(zero_copy_only=False), np.int64) for v in (tops.flatten(), tops.value_lengths()))
                arrays = (ids, keys, labels, np.zeros(0, np.uint8), root_up((x**2).sum(1)), x, ends, counts)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in arrays], ["ids", "keys", "labels", "codes", "norms", "data", "tops", "counts"])

    return anchors.mapInArrow(run, f"{BLOCK}, tops binary, counts binary")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label,
    CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""


def query(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)
