"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch, ship

#: What separates words: the ASCII white space of the word pattern [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to a Python worker, so that long texts cannot pile up.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: A key with a HOT-th of all rows or more is hot, so there are HOT of them at most.
HOT = 4096


def bound_batches(spark: SparkSession) -> None:
    """Readies the session for Python operators: Arrow batches bounded by rows and bytes, and the package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_made: list[list[str]] = []


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    The copy outlives lost executors. It is removed when the driver ends, or sooner by settled() or replaced().
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    for made in _made[-1:]:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def replaced(old: DataFrame, new: DataFrame, what: str) -> DataFrame:
    """written(new), after which the copy that old is read from goes; nothing else may read it any more."""
    out = written(new, what)
    remove(old.sparkSession, old._written)
    return out


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """written(make()), after which all copies go that make() has written on its way."""
    _made.append([])
    try:
        df = make()
    finally:
        own = _made.pop()
    out = written(df, what)
    for path in own:
        remove(out.sparkSession, path)
    return out


def join_skewed(rows: DataFrame, table: DataFrame, on: Column, count: str, total: int) -> DataFrame:
    """Inner join of rows with table, whose keys are unique and whose column count says how many rows have the key.

    The counts sum to total at most, so HOT keys at most hold a HOT-th of it: those are broadcast, and
    their rows stay where they are. The others' rows are shuffled.
    """
    hot = F.col(count) * HOT >= total
    few = F.broadcast(table.where(hot))
    rest = rows.join(few, on, "left_anti").join(table.where(~hot), on)
    return rows.join(few, on).unionByName(rest)


#: Bits of marks(): 8 MB, whatever the number of keys.
MARKS = 1 << 26


def marks(keys: DataFrame, h: Column) -> DataFrame:
    """A bitmap of the hashes h of keys, as rows (_bucket, _bits) of 4 KB, to broadcast; MARKS bits at most."""
    v = keys.select((F.pmod(h, F.lit(MARKS)) + 1).alias("v"))
    bits = v.groupBy(F.bitmap_bucket_number("v").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits"))
    return F.broadcast(written(bits, "marks"))


def marked(rows: DataFrame, h: Column, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose hash h has its bit set, among them all whose hash is one of the keys'; with left_anti the others. Nothing is shuffled."""
    v = F.pmod(h, F.lit(MARKS)) + 1
    at = F.bitmap_bit_position(v)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(bits, (F.bitmap_bucket_number(v) == F.col("_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1), how)


def parts(df: DataFrame) -> int:
    """How many partitions to deal out to: the session's setting, or the input's splits if more."""
    set_to = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(set_to, df.rdd.getNumPartitions())


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string, made on the driver for use in workers."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(rows: Iterable, size: int, length=len) -> Iterator[list]:
    """Lists of rows whose lengths sum to about size; a longer row stands alone."""
    out, n = [], 0
    for r in rows:
        k = length(r)
        if out and n + k > size:
            yield out
            out, n = [], 0
        out.append(r)
        n += k
    if out:
        yield out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive pieces with these lengths."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out
