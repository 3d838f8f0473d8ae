"""Structured Streaming over the events table: windows, sessions, deduplication, joins, state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import exists, scratch


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """events as a stream; ts becomes a zoned timestamp, as watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    return raw.parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: Keyed state of any kind needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns the result table, written in the shared folder.

    append: a Parquet sink. update, complete: each batch has a folder of its own, so a batch that is run
    again replaces itself; update gives all batches' rows, complete those of the last.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{path}/out").start()
        else:
            query = writer.foreachBatch(lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    if not exists(spark, f"{path}/out"):  # no batch came
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(df.schema if mode == "append" else f"{_ddl(df)}, batch int").parquet(f"{path}/out")
    if mode == "append":
        return out
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bounds(df: DataFrame, window: str = "window") -> DataFrame:
    return df.withColumn("start_ts", F.col(f"{window}.start").cast("timestamp_ntz")).drop(window)


def tumbling(s: DataFrame) -> DataFrame:
    return _bounds(s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")))


def sliding(s: DataFrame) -> DataFrame:
    return _bounds(s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n")))


def session(s: DataFrame) -> DataFrame:
    g = s.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return _bounds(g, "session_window")


def deduplicated(s: DataFrame) -> DataFrame:
    return s.withWatermark("ts", "31 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def view_then_purchase(s: DataFrame) -> DataFrame:
    """Stream-stream interval join: purchases within an hour after a view of the same user."""
    v = s.where("event_type = 'view'").select(F.col("user_id").alias("vu"), F.col("ts").alias("vts"), F.col("event_id").alias("view_id")).withWatermark("vts", "1 hour")
    p = s.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id")).withWatermark("ts", "1 hour")
    return p.join(v, F.expr("user_id = vu AND vts <= ts AND vts >= ts - INTERVAL 1 HOUR")).select("view_id", "purchase_id")


class Running(StatefulProcessor):
    """Counts a user's events across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(pdf) for pdf in rows)
        self.n.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def running_counts(s: DataFrame) -> DataFrame:
    return s.groupBy("user_id").transformWithStateInPandas(Running(), "user_id long, n long", "Update", "None")
