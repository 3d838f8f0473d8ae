"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's bytes are lower-cased (A-Z) and its words set between single spaces. Every 3- to 6-byte
window inside a word, its bordering spaces included, is hashed to a row of an embedding table; the
text's vector is the mean of its rows, and a two-class softmax stands on it. Table and softmax are
trained together. A misspelling keeps most windows of the word, and so most of its vectors.

Every window seen in training has a row of its own and all rows are trained; none is left out. A window
enters with a gain, the square of its smoothed log odds over the two classes' texts, in place of its share
alone: under one step size and decay, windows that tell the classes apart then move far and those of
every text, or of one text only, hardly move, so the noise of long texts and of wrong labels isn't learned by
heart. The smoothing is SMOOTH plus LEAST texts of the smaller class, so it follows the number of rows.

After training, a row of the table acts through its product with the softmax's weights alone, so
scoring sums one number for each window and needs no table of vectors on the executors.

Bounds: a sample of labelled rows is fetched for training: of each class those of the lowest hashes of
their ids, TRAIN_ROWS / 2 labels and TRAIN_BYTES / 2 bytes of whole texts at most; a text that no longer
fits is passed over. The bias is set right for the classes' shares of all labels. Scoring reads every whole
text, CHUNK bytes or one text at a time.

Defined results: null or empty text: the score of the bias alone; null labels are not learned from;
null ids are held out, by the crc32 of "None"; an id with both labels is learned with each, an id with several
texts with each of them; labels of one class only or none: all scores are that of the class's share, 0.25
without labels; empty tables: no rows; repeated rows: repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_chunks, raw_texts, written

BUCKET_BITS, DIMS, SIZES = 20, 8, (3, 4, 5, 6)
TRAIN_ROWS, TRAIN_BYTES, CHUNK = 6000, 6 << 20, 1 << 18
SMOOTH, LEAST, SCALE = 0.02, 3, 300.0


def windows(texts: list[bytes]):
    """(start of each text, then for each size the buckets at each place and which of them count)."""
    words = [b" " + b" ".join(t.lower().split()) + b" " for t in texts]
    size = np.array([len(w) for w in words])
    buf = np.frombuffer(b"".join(words), np.uint8)
    n = len(buf)
    space = np.concatenate([[0], np.cumsum(buf == 32, dtype=np.int32)])
    ends = np.cumsum(size)
    x = buf.astype(np.uint32)
    out = []
    for k in SIZES:
        m = max(0, n - k + 1)
        h = np.full(m, (2166136261 + k) & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h ^= x[j : j + m]
            h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h &= np.uint32((1 << BUCKET_BITS) - 1)
        ok = space[k - 1 : k - 1 + m] == space[1 : 1 + m]  # no space strictly inside
        for j in range(1, k):
            ok[np.maximum(ends[ends - j < m] - j, 0)] = False  # nor across texts
        out.append((h, ok))
    return ends - size, size, out


def bags(texts: list[bytes]):
    """Chunk by chunk (text, bucket, share) of the distinct windows of each text, in order of the texts."""
    at = 0
    for chunk in in_chunks(texts, CHUNK):
        _, size, found = windows(chunk)
        doc = np.repeat(np.arange(len(chunk), dtype=np.int64), size)
        key = np.concatenate([doc[: len(h)][ok] << BUCKET_BITS | h[ok] for h, ok in found])
        key, count = np.unique(key, return_counts=True)
        r = key >> BUCKET_BITS
        n = np.bincount(r, count, len(chunk))
        yield r + at, key & (1 << BUCKET_BITS) - 1, count / n[r]
        at += len(chunk)


def gains(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The gain of each bucket: its squared log odds, smoothed, over the texts of the classes."""
    size, n1, n0 = 1 << BUCKET_BITS, y.sum(), len(y) - y.sum()
    h = np.bincount(ids, minlength=size)
    h1 = np.bincount(ids, y[rows], size)
    a = SMOOTH + LEAST / min(n1, n0)
    return np.where(h > 0, np.log((h1 / n1 + a) / ((h - h1) / n0 + a)) ** 2, 0).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, prior: float | None = None, epochs: int = 20, rate: float = 0.05, seed: int = 7):
    """(score of each bucket, bias): embeddings and softmax by Adam on the joint loss, in mini-batches.

    The loss's gradient in a row is one number times the softmax's weight difference, so a step scatters
    numbers, not vectors. prior: the share of label 1 that the bias is set right for, by default the sample's.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    y = np.asarray(labels, np.float64)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()), 0.01), 0.49) if len(y) else 0.25
        return np.zeros(size, np.float32), float(np.log(p / (1 - p)))
    kept = [(r.astype(np.int32), f.astype(np.int32), x.astype(np.float32)) for r, f, x in bags(texts)]
    rows, ids, x = (np.concatenate(c) for c in zip(*kept, strict=True))
    kept.clear()
    gain = gains(ids, rows, y)
    seen = np.unique(ids)
    row_of = np.zeros(size, np.int32)
    row_of[seen] = np.arange(len(seen))
    x *= SCALE
    x *= gain[ids]
    ids = row_of[ids]
    bounds = np.searchsorted(rows, np.arange(len(y) + 1))
    del rows
    table, weight, bias = rng.normal(0, 0.01, (len(seen), DIMS)).astype(np.float32), rng.normal(0, 1, (DIMS, 2)), np.zeros(2)
    moments = [np.zeros(v.shape, np.float32) for v in (table[:, 0], table[:, 0], weight, weight, bias, bias)]
    step, batches = 0, max(1, min(16, len(y) // 32))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(y)), batches):
            cut = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            r, f, v = np.repeat(np.arange(len(batch)), bounds[batch + 1] - bounds[batch]), ids[cut], x[cut]
            diff = weight[:, 1] - weight[:, 0]
            z = np.bincount(r, (table @ diff)[f] * v, len(batch)) + bias[1] - bias[0]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            scalar = np.bincount(f, err[r] * v, len(seen))
            grad = table.T @ scalar
            step += 1
            moves = []
            for i, g in enumerate((scalar, np.stack([-grad, grad], 1), err.sum() * np.array([-1, 1]))):
                moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
                moments[2 * i + 1] = 0.999 * moments[2 * i + 1] + 0.001 * g * g
                moves.append(lr * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * moments[2 * i] / (np.sqrt(moments[2 * i + 1]) + 1e-8))
            table -= (moves[0][:, None] * diff / np.linalg.norm(diff)).astype(np.float32)
            weight -= moves[1]
            bias -= moves[2]
    score = np.zeros(size, np.float32)
    score[seen] = SCALE * gain[seen] * (table @ (weight[:, 1] - weight[:, 0]))
    odds = y.mean() / (1 - y.mean())
    prior = min(max(prior, 1e-6), 1 - 1e-6) if prior is not None else y.mean()
    return score, float(bias[1] - bias[0] + np.log(prior / (1 - prior)) - np.log(odds))


def score_texts(texts: list[bytes], score: np.ndarray, bias: float) -> np.ndarray:
    """Softmax scores of whole texts."""
    out = []
    for chunk in in_chunks(texts, CHUNK):
        starts, size, found = windows(chunk)
        sums, n = np.zeros(len(chunk)), np.zeros(len(chunk))
        total = int(size.sum())
        values, counted = np.zeros(total), np.zeros(total, np.int32)
        for h, ok in found:
            values[: len(h)] += score[h] * ok
            counted[: len(h)] += ok
        sums = np.add.reduceat(values, starts)
        n = np.add.reduceat(counted, starts)
        out.append(1 / (1 + np.exp(-np.clip(sums / np.maximum(n, 1) + bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id) -> bool:
    """The contract's fold: crc32 of the id as text, mod 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray, float | None]:
    """Texts and labels of a bounded sample of labelled rows outside the held-out fold, and the share of label 1 of all."""
    own = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("y")).where("y IN (0, 1) AND label_id IS NOT NULL")
    own = own.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0)
    share = own.agg(F.avg("y")).first()[0]
    least = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(rows // 2)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(least(0).unionByName(least(1)).distinct()), F.col("doc_id") == F.col("label_id"))
    place = [F.xxhash64("label_id").alias("a"), "label_id", "y", F.xxhash64("text").alias("b")]
    found = written(found.select("text", *place), "labelled")
    sizes = found.select("a", "label_id", "y", "b", F.octet_length("text").alias("size")).distinct().orderBy("a", "label_id", "y", "b").limit(2 * rows).collect()
    left, keys = {0: most // 2, 1: most // 2}, []
    for r in sizes:
        if r.size <= left[r.y]:
            left[r.y] -= r.size
            keys.append((r.label_id, r.y, r.b))
    kind = found.schema["label_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(keys, f"label_id {kind}, y int, b long")
    got = found.join(F.broadcast(chosen), ["label_id", "y", "b"]).groupBy("label_id", "y", "b").agg(F.first("text").alias("text")).toArrow()
    order = sorted(zip(got["label_id"].to_pylist(), got["b"].to_pylist(), got["y"].to_pylist(), raw_texts(got["text"].combine_chunks()), strict=True))
    return [t for *_, t in order], np.array([y for _, _, y, _ in order]), share


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    score, bias = train(*training_rows(docs, labels))
    model = spark.sparkContext.broadcast((score, bias))  # 2**BUCKET_BITS numbers, however large the corpus
    rows = docs.select(F.col("doc_id"), F.col("text"))

    def run(batches):
        for b in batches:
            s = score_texts(raw_texts(b.column(1)), *model.value)
            held = pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), held, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
