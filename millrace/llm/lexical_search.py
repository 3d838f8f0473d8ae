"""Ranked lexical search by WAND, shard by shard of the documents.

1. Terms of each whole text are counted; of the queries' terms, each document keeps (term, occurrences): the index, a table in
   the shared folder. Numbers of documents and terms, and of documents with a term, are sums over all of it.
2. Each task takes its documents as shards of SHARD, each inverted to posting lists by term with the greatest impact that the
   term has there. WAND runs for each query: cursors stand in order of their documents, and the pivot is the first at which the
   greatest impacts summed up reach the heap's threshold. No document before the pivot can enter the heap, so all cursors skip to
   it. From the pivot on a window of WINDOW documents is judged at once in arrays: those whose present terms' greatest
   impacts stay below the threshold are skipped, the others scored. The heap goes on from a shard to the next of its task.
3. Heaps of all tasks are merged: the best of each query.

Scores follow the contract's whole-number arithmetic; sums of impacts stay below 2**53, so they are exact in double precision.
A document that ties with the threshold is never skipped, so ties are decided by id alone.

Bounds: queries are on the driver in blocks of MOST_BYTES of text, each with an index of its own; a task holds one shard,
at most its documents times the queries' terms. Texts are cut at separators into pieces of PIECE bytes while they are counted. A task gives at
most k rows for each query.

Defined results: null, empty and termless texts count for nothing and are never found; texts of any length are read whole; repeated rows each
count and take a rank each; null ids come last among ties; a query without terms, a null one or one without any document of score above 0 gives no
row; repeated queries, null ids among them, give rows each; empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, raw_texts, written

K, SHARD, WINDOW = 50, 1 << 15, 1 << 11
MOST_BYTES, PIECE = 8 << 20, 1 << 20
#: A-Z become a-z, all ASCII that is no letter or digit a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LAST = np.iinfo(np.int64).max  # what a null id counts as


def pieces(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in lower case with spaces for separators, cut at spaces into pieces of about size bytes."""
    plain, at, size = text.translate(TABLE), 0, size or PIECE
    while len(plain) - at > size:
        end = plain.find(b" ", at + size)
        if end < 0:
            break
        yield plain[at:end]
        at = end
    yield plain[at:] if at else plain


def counts_of(text: bytes) -> Counter:
    """How often each term stands in a text."""
    out: Counter = Counter()
    for p in pieces(text):
        out.update(p.split())
    return out


@dataclass
class Queries:
    """Queries as numbers of terms; terms are those of these queries alone."""

    ids: list
    terms: dict[bytes, int]
    of: list[np.ndarray]

    @classmethod
    def make(cls, ids: list, texts: list[bytes]) -> Queries:
        found = [sorted(counts_of(t)) for t in texts]
        terms = {t: i for i, t in enumerate(sorted({t for x in found for t in x}))}
        return cls(ids, terms, [np.array([terms[t] for t in x], np.int64) for x in found])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2 n + 2) / (2 df + 1))) of each term."""
    return np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)


class Shard:
    """Posting lists of a shard: documents by number, in order, with impacts, and each term's greatest impact."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n: int, length: int):
        self.ids = ids
        m = 50 + 50 * size * n // max(length, 1)
        order = np.argsort(term, kind="stable")  # documents stay in order
        term, self.doc, tf = term[order], doc[order].astype(np.int32), tf[order]
        self.impact = (weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))).astype(np.float64)
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight))
        full = np.flatnonzero(np.diff(self.at))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impact, self.at[full])


class Heap:
    """The k best documents of a query so far: by score, then id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def threshold(self) -> float:
        """What a document must reach to enter; scores above 0 are whole numbers."""
        return self.score[-1] if len(self.score) == self.k else 1.0

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.append(self.ids, ids)
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]


def wand(shard: Shard, terms: np.ndarray, heap: Heap, window: int = WINDOW) -> int:
    """Adds a shard's documents to the heap of a query; returns how many were scored."""
    terms = terms[shard.most[terms] > 0]
    lists = [(shard.doc[shard.at[t] : shard.at[t + 1]], shard.impact[shard.at[t] : shard.at[t + 1]]) for t in terms]
    most, end, scored = shard.most[terms], len(shard.ids), 0
    place = np.zeros(len(terms), np.int64)
    cursor = np.array([docs[0] for docs, _ in lists], np.int64)
    while len(terms):
        order = np.argsort(cursor, kind="stable")
        reach = np.cumsum(most[order]) >= heap.threshold()
        if not reach.any() or (pivot := cursor[order[reach.argmax()]]) == end:
            return scored
        upper, own, value, bound = pivot + window, [], [], []
        for i, (docs, impact) in enumerate(lists):
            if cursor[i] < upper:
                a, b = np.searchsorted(docs, (pivot, upper)) if cursor[i] < pivot else (place[i], np.searchsorted(docs, upper))
                own.append(docs[a:b])
                value.append(impact[a:b])
                bound.append(np.full(b - a, most[i]))
                place[i], cursor[i] = b, docs[b] if b < len(docs) else end
        own, value = np.concatenate(own) - pivot, np.concatenate(value)
        can = np.bincount(own, np.concatenate(bound)) >= heap.threshold()
        hit = can[own]
        if hit.any():
            score = np.bincount(own[hit], value[hit])
            found = np.flatnonzero(score >= heap.threshold())
            scored += int(can.sum())
            heap.add(score[found], shard.ids[found + pivot])
    return scored


#: A document of the index: its number of terms, and those of the queries' terms that it holds, with their occurrences.
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def indexed(docs: DataFrame, queries: Queries) -> DataFrame:
    """The index of documents (doc_id, text) for the terms of these queries."""
    spark = docs.sparkSession
    held, schema = spark.sparkContext.broadcast(queries.terms), arrow_schema(spark, INDEX)

    def run(batches):
        known = held.value
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                c = counts_of(t)
                own = sorted((known[x], c[x]) for x in c.keys() & known.keys())
                rows.append((i, c.total(), [k for k, _ in own], [f for _, f in own]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term stands: each task sums up its own, Spark the tasks'."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(total[t])], ["term", "n"])

    got = index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def heaps(index: DataFrame, queries: Queries, k: int, shard: int, window: int) -> DataFrame:
    """query, doc_id, score: the k best documents of each query in each task."""
    spark = index.sparkSession
    n, length = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    weight = weights(frequencies(index, len(queries.terms)), n)
    held = spark.sparkContext.broadcast((queries.of, weight))

    def run(batches):
        of, weight = held.value
        found = [Heap(k) for _ in of]
        for t in _shards(batches, shard):
            terms, tfs = (t[c].combine_chunks() for c in ("terms", "tfs"))
            own = np.repeat(np.arange(t.num_rows), terms.value_lengths().to_numpy())
            s = Shard(t["doc_id"].to_numpy(), t["n"].to_numpy(), own, terms.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), weight, n, length)
            for heap, own in zip(found, of, strict=True):
                wand(s, own, heap, window)
        size = np.array([len(h.ids) for h in found], np.int64)
        columns = (np.repeat(np.arange(len(found), dtype=np.int32), size), np.concatenate([np.zeros(0, np.int64), *(h.ids for h in found)]), np.concatenate([np.zeros(0), *(h.score for h in found)]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "doc_id", "score"])

    named = index.where(F.size("terms") > 0).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(LAST))))
    return named.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(items: DataFrame, most: int) -> Iterator[Queries]:
    """The queries (item_id, text), in blocks of about `most` bytes."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n = -(-(size or 0) // most) or 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        got = part.toArrow()
        rows = sorted(zip(got["item_id"].to_pylist(), raw_texts(got["text"].combine_chunks()), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Queries.make([i for i, _ in rows], [t for _, t in rows])


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, window: int = WINDOW, most: int = MOST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark, out = docs.sparkSession, None
    bound_batches(spark)
    for queries in _blocks(items.select("item_id", "text"), most):
        found = heaps(written(indexed(docs, queries), "index"), queries, k, shard, window)
        by = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", F.nullif("doc_id", F.lit(int(LAST))).alias("doc_id"), "score")  # names: one block of queries
        out = part if out is None else out.unionByName(part)
    return out


#: Terms by the contract's pattern: what is left once A-Z are lower case.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
f AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, n_docs),
m AS (SELECT doc_id, 50 + ((50 * len(ts) * n_docs) // n_terms) AS m FROM d, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
