"""Token counts by a separator scan over flat token files.

pack_tokens writes each input split as one flat run of token ids, documents ended by an
end-of-document id and without any index, cut into blocks of equal size. scan_blocks finds the
separators of each block by one vectorised comparison and knows nothing of documents: a document may
begin in one block and end many blocks later. A prefix scan over the blocks' separator counts
numbers the documents, and the pieces at block borders are summed by that number.

Bounds: a task holds one block; the scan's window holds one short row a block; only border pieces
are shuffled, one or two a block.

Long white space runs are encoded as the single pieces that the pattern makes of them, which its engine would find in
quadratic time, so texts of any length and kind get the tokens of the uncut encoding.

Defined results: null or empty text: 0 tokens; ids are whole numbers; an unfinished last document is reported where it has
tokens; empty table: no rows; repeated rows: repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, raw_texts, written

#: Fixed values of the public byte-level vocabulary: its pattern, and the id free for a separator.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
#: White space as the pattern takes it, in runs of which its engine would try every length.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{64,}")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 18

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    """One tokenizer for each worker process and vocabulary."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        made = lambda pattern: tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _encoders[key] = made(PATTERN)
        _encoders[key].whole = made(r"[\s\S]+")  # takes a text as one piece
    return _encoders[key]


def encode(enc, text: str) -> list[int]:
    """Token ids of a text: of a run of white space the pattern takes all but the last place as one piece, or all at the end."""
    out, at = [], 0
    for m in LONG_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc.whole.encode_ordinary(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if out or at else enc.encode_ordinary(text)


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file_id, kind, seq, payload: blocks of uint16 token ids (kind 0), and apart from them the doc ids in order (kind 1)."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary file: under 2 MB

    def run(batches):
        enc, file_id = _encoder(ranks.value), TaskContext.get().partitionId()
        end, held, n, seq, page = np.array([EOD], np.uint16), [], 0, 0, 0

        def rows(kind, first, payloads):
            k = len(payloads)
            return pa.RecordBatch.from_arrays(
                [pa.array([file_id] * k, pa.int64()), pa.array([kind] * k, pa.int32()), pa.array(range(first, first + k), pa.int64()), pa.array(payloads, pa.binary())],
                ["file_id", "kind", "seq", "payload"],
            )

        for b in batches:
            blocks = []
            for t in raw_texts(b.column(1)):
                ids = np.array(encode(enc, t.decode("utf-8", "replace")), np.uint16)
                held += [ids, end]
                n += len(ids) + 1
                if n >= block_tokens:
                    flat = np.concatenate(held)
                    cut = n // block_tokens * block_tokens
                    blocks += [flat[i : i + block_tokens].tobytes() for i in range(0, cut, block_tokens)]
                    held, n = [flat[cut:]], n - cut
            if blocks:
                yield rows(0, seq, blocks)
                seq += len(blocks)
            yield rows(1, page, [_ids(b.column(0))])
            page += 1
        if n:
            yield rows(0, seq, [np.concatenate(held).tobytes()])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "file_id long, kind int, seq long, payload binary")


def _ids(column: pa.Array) -> bytes:
    """Ids as an Arrow stream, nulls kept."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], names=["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def flat_file_blocks(spark, path: str, dtype: str = "uint16", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, seq, payload of raw flat files under a path that Spark can read (up to 2 GB a file)."""
    step = np.dtype(dtype).itemsize * block_tokens

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_buffer()
                for seq, at in enumerate(range(0, data.size, step)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([seq], pa.int64()), pa.array([data.slice(at, min(step, data.size - at)).to_pybytes()], pa.binary())],
                        ["file_id", "seq", "payload"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file_id string, seq long, payload binary")


def scan_blocks(blocks: DataFrame, eod: int = EOD, dtype: str = "uint16") -> DataFrame:
    """file_id, ordinal, n_tokens, ended of the documents in flat blocks (file_id, seq, payload)."""
    kind = blocks.schema["file_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            pieces = []
            for p in b.column(2):
                ids = np.frombuffer(p.as_buffer(), dtype)
                at = np.flatnonzero(ids == eod)
                # lengths between separators; the last one is what follows the last separator
                pieces.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(p) - 1 for p in pieces], pa.int64()), pa.array(pieces, pa.list_(pa.int64()))],
                ["file_id", "seq", "n_ends", "pieces"],
            )

    scanned = blocks.select("file_id", "seq", "payload").mapInArrow(run, f"file_id {kind}, seq long, n_ends long, pieces array<long>")
    before = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = scanned.withColumn("base", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    each = numbered.select("file_id", "n_ends", "base", F.posexplode("pieces").alias("pos", "n_tokens"))
    # a piece between two separators of one block is a whole document
    piece = each.select("file_id", (F.col("base") + F.col("pos")).alias("ordinal"), "n_tokens", (F.col("pos") < F.col("n_ends")).alias("ended"), ((F.col("pos") > 0) & (F.col("pos") < F.col("n_ends"))).alias("whole"))
    stitched = piece.where("NOT whole").groupBy("file_id", "ordinal").agg(F.sum("n_tokens").alias("n_tokens"), F.max("ended").alias("ended"))
    return piece.where("whole").select("file_id", "ordinal", "n_tokens", "ended").unionByName(stitched.where("ended OR n_tokens > 0"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, file_id, ordinal, n_tokens for each row of docs."""
    files = written(pack_tokens(docs, vocabulary), "tokens")
    counts = scan_blocks(files.where("kind = 0"))

    def names(batches):
        for b in batches:
            for f, page, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = pa.ipc.open_stream(p.as_buffer()).read_all()["doc_id"].combine_chunks()
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * k, pa.int64()), pa.array([page] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([k] * k, pa.int64()), ids],
                    ["file_id", "page", "slot", "n", "doc_id"],
                )

    listed = files.where("kind = 1").select("file_id", "seq", "payload")
    pages = listed.mapInArrow(names, "file_id long, page long, slot long, n long, doc_id long")
    sizes = pages.groupBy("file_id", "page").agg(F.first("n").alias("n_page"))
    before = Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file_id", "page", F.coalesce(F.sum("n_page").over(before), F.lit(0)).alias("base"))
    order = pages.join(base, ["file_id", "page"]).select("file_id", (F.col("base") + F.col("slot")).alias("ordinal"), "doc_id")
    return order.join(counts, ["file_id", "ordinal"]).select("doc_id", "file_id", "ordinal", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
