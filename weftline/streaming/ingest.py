"""Incremental ingest: each key of a stream of files passes once, or whenever its content changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import scans
from ..sources import snapshots


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Rows whose key has not been seen. With a time column keys are forgotten after ``delay``; without one the state only grows."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there, append it as Parquet and end; the checkpoint keeps what was seen."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def changes(rows: DataFrame, known: DataFrame, key: str, time: str, content: Column | None, ttl: str) -> tuple[DataFrame, DataFrame]:
    """(rows of (key, time, ...) whose content differs from the key's last one, or that come more than ``ttl`` after it; the new state (key, time, hash)).

    Without ``content`` a key passes once in a ttl. known is the state so far; what the clock, the latest time, is more than ttl past is forgotten. Rows of equal time go by hash.
    """
    hashed = rows.withColumn("_hash", F.lit("") if content is None else F.coalesce(F.sha2(content, 256), F.lit("")))
    seen = F.struct(F.col(time).alias("time"), F.col("_hash").alias("hash"))
    ordered = scans.scan(hashed, key, [time, "_hash"], {"_last": scans.latest(seen)})
    stored = known.select(F.col("key").alias("_key"), F.struct("time", "hash").alias("_stored"))
    ordered = ordered.join(stored, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_last", F.coalesce("_last", "_stored"))
    fresh = F.col("_last").isNull() | (F.col("_last.hash") != F.col("_hash")) | (F.col(time) > F.expr(f"_last.time + interval {ttl}"))
    now = hashed.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col("_hash").alias("hash"))
    latest = known.select("key", "time", "hash").union(now).groupBy("key").agg(F.max(F.struct("time", "hash")).alias("x")).select("key", "x.time", "x.hash")
    clock = latest.agg(F.max("time").alias("_clock"))
    state = latest.join(F.broadcast(clock), F.expr(f"time + interval {ttl} >= _clock")).drop("_clock")  # one row
    return ordered.where(fresh).drop("_last", "_key", "_stored", "_hash"), state


def run_changes(stream: DataFrame, key: str, time: str, content: Column | None, ttl: str, store: str, out: str, checkpoint: str) -> None:
    """Take what is there, append the ``changes`` as Parquet under out, replace the state under store, and end.

    Input must come in order of time from batch to batch. A batch writes a folder of its own, which a repeated batch overwrites, then the state with the batch's number: a batch whose
    state is committed is skipped, so a restart between the two neither loses nor repeats a row. The state holds the keys of the last ttl only.
    """
    kinds = dict(stream.dtypes)
    schema = f"key {kinds[key]}, time {kinds[time]}, hash string"

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        last = snapshots.committed(spark, store)
        if last is not None and int(last["label"]) >= number:
            return
        rows.persist()  # read for the changes and for the state
        try:
            found, state = changes(rows, snapshots.read(spark, store, schema), key, time, content, ttl)
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")
            snapshots.write(state, store, str(number))
            snapshots.expire(spark, store)
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
