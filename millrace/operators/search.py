"""Searches: vectors, many queries against all rows in blocks; similar sets by their rarest items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping, sets

QUERIES, ROWS = 256, 2048  # vectors of a block


def blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Blocks of up to size rows: name_ids and name_data, the vectors as doubles; a null vector is all NaN."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                rows = part.column(1).to_pylist()
                width = max((len(x) for x in rows if x is not None), default=1)
                data = np.array([[np.nan] * width if x is None else x for x in rows], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], [f"{name}_ids", f"{name}_data"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, f"{name}_ids array<long>, {name}_data binary")


def best_of_each(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, cosine: bool) -> DataFrame:
    """query_id, key, score: the k rows of the highest score for each query, ties by key; keys are unique.

    Each pair of blocks gives the k best of its rows for each of its queries, so what is shuffled is
    k rows a query and block of rows, never the product. Scores are summed place by place in double
    precision, so equal vectors have equal scores in any block. A score is null with a null vector
    and, for cosine, with a zero vector; nulls come last.
    """
    pairs = blocks(queries, key, vector, QUERIES, "q").crossJoin(blocks(rows, key, vector, ROWS, "r"))

    def run(batches):
        for b in batches:
            for q_ids, q_data, r_ids, r_data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q, r = (np.frombuffer(x, np.float64).reshape(len(i), -1) for i, x in ((q_ids, q_data), (r_ids, r_data)))
                dot, q2, r2 = np.zeros((len(q), len(r))), np.zeros(len(q)), np.zeros(len(r))
                for p in range(min(q.shape[1], r.shape[1])):
                    dot += q[:, p, None] * r[None, :, p]
                    q2, r2 = q2 + q[:, p] ** 2, r2 + r[:, p] ** 2
                if cosine:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dot /= np.sqrt(q2)[:, None] * np.sqrt(r2)[None]
                ids = np.array(r_ids, np.int64)
                low = np.where(np.isnan(dot), np.inf, -dot)
                top = np.lexsort((np.broadcast_to(ids, low.shape), low), axis=1)[:, :k]
                score = np.take_along_axis(dot, top, 1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(q_ids, np.int64), top.shape[1])), pa.array(ids[top].ravel()), pa.array(score, mask=np.isnan(score))], ["query_id", key, "score"]
                )

    found = pairs.mapInArrow(run, f"query_id long, {key} long, score double")
    return grouping.top_k(found, ["query_id"], [F.col("score").desc_nulls_last(), F.col(key)], k)


def similar_sets(df: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a, b, shared, united: pairs a < b of rows whose sets (array column items) have a Jaccard similarity of least or more.

    None is missed: candidates share one of their rarest items (`sets`), and the sets decide. A set goes once to each pair of chunks in which it
    has a candidate, never to each candidate. df is read three times, so that nothing whole is written. Keys are whole numbers, unique and not null; null and
    empty sets are similar to nothing.
    """
    rows = sets.hashed(df, key, items)
    found = sets.prefixes(rows, least)
    pairs = sets.verified(sets.candidates(found, least), rows, found)
    return pairs.where(F.col("shared") >= F.lit(least) * F.col("united"))
