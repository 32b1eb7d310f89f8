"""Intraday streams: fifteen-minute bars with late data, and a gate that confirms a state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet source as a stream, its event time as an instant in UTC. The path is given as a pattern, as a source that
    is one file isn't taken as a plain path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, late: str = "31 days") -> DataFrame:
    """Counts, sums and extremes by type and quarter of an hour; events later than ``late`` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "15 minutes").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")).select("event_type", F.col("w.start").alias("start"), "n", "total", "low", "high")


def persistence(events: DataFrame, level: float = 50.0, on: int = 3, off: int = 3) -> DataFrame:
    """For each user a gate that opens after ``on`` events in a row above the level and closes after ``off`` in a row at or
    below; emits how often it has opened, and whether it is open. The state is three numbers a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, is_open, run = state.get if state.exists else (0, False, 0)
        seen = pd.concat(frames).sort_values(["ts", "event_id"])
        for above in (seen["value"] > level).tolist():
            run = run + 1 if above != is_open else 0
            if run >= (off if is_open else on):
                opened, is_open, run = opened + (not is_open), not is_open, 0
        state.update((opened, is_open, run))
        yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "is_open": [is_open]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, opened long, is_open boolean", "opened long, is_open boolean, run long", "update", "NoTimeout")


#: Keyed state on disk.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drain(stream: DataFrame, key: list[str], mode: str = "update", conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what its source holds, and give the last row of each key. Settings of ``conf`` hold for this stream alone."""
    spark = stream.sparkSession
    conf = conf or {}
    base = f"{(spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/part={epoch}")

    spark.createDataFrame([], stream.schema).withColumn("epoch", F.lit(-1)).write.parquet(f"{base}/out/part=-1")  # a stream without rows runs no batch
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(emit).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    columns = [c for c in stream.columns if c not in key]
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return found.groupBy(*key).agg(F.max_by(F.struct(*columns), "epoch").alias("last")).select(*key, "last.*")
