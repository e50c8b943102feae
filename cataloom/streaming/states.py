"""Streaming forms of the batch operators: remembered state, sessions, pending rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cataloom.operators.sync import upsert


def remembered(stream: DataFrame, folder: str, key: str, days: str, rating: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the state below ``folder``, one version per batch so that a retry is harmless; older ones than the last two go."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key, days, rating)
        if number:
            known = spark.read.parquet(f"{folder}/v={number - 1}")
        else:
            known = spark.createDataFrame([], new.schema)
        upsert(known, new, key, days, rating).select(key, days, rating).write.mode("overwrite").parquet(f"{folder}/v={number}")
        _forget(spark, f"{folder}/v={number - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, at: str, group: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events without a gap as long as ``gap``: start, end and count; rows later than ``late`` are dropped."""
    window = F.session_window(at, gap)
    grouped = stream.withWatermark(at, late).groupBy(window, *group).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*group, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def counted(stream: DataFrame, folder: str, feed: str, signature: str, at: str, checkpoint: str) -> StreamingQuery:
    """Appends rows (batch=n below ``folder``) with ``number``, which runs on within a feed over all batches and restarts.

    What was done is marked by its signature: of rows of one feed and signature only the first ever counts, by keyed state in the checkpoint.
    Numbers go on from a small table of each feed's last one, one version per batch, in order of ``at`` and signature. A batch that is
    run again reads the version before its own and writes the same rows over, so a failure in the middle changes no number.
    """
    last = f"{folder}/last"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kinds = batch.select(F.col(feed)).withColumn("before", F.lit(0).cast("long")).schema
        known = spark.read.schema(kinds).parquet(f"{last}/v={number - 1}") if number else spark.createDataFrame([], kinds)
        order = Window.partitionBy(feed).orderBy(at, signature)
        placed = batch.join(known, feed, "left").withColumn("number", F.coalesce("before", F.lit(0)) + F.row_number().over(order)).drop("before")
        placed.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        done = spark.read.schema(placed.schema).parquet(f"{folder}/rows/batch={number}").groupBy(feed).agg(F.max("number").alias("before"))
        ahead = known.unionByName(done).groupBy(feed).agg(F.max("before").alias("before"))
        ahead.write.mode("overwrite").parquet(f"{last}/v={number}")
        _forget(spark, f"{last}/v={number - 2}")

    marked = stream.dropDuplicates([feed, signature])
    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, path: str) -> None:
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a folder of its own (batch=n), so that one that is written again does not count twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting(stream: DataFrame, key: str, kind: str, at: str, late: str, wait_seconds: int) -> DataFrame:
    """(key, state, at) of rows of kind "sent": "confirmed" once a row of kind "seen" comes, "offer" where none comes within the wait.

    State is one time per key that waits; event-time timers end it. A row "seen" that nothing was sent for is passed over.
    """
    name = stream.schema[key]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answer = lambda word, ms: pd.DataFrame({key: [group[0]], "state": [word], "at": [pd.Timestamp(ms, unit="ms")]})
        if state.hasTimedOut:
            (sent,) = state.get
            state.remove()
            yield answer("offer", sent)
            return
        sent, seen = state.get[0] if state.exists else None, False
        for part in parts:
            for what, when in zip(part[kind], part[at], strict=True):
                if what == "sent":
                    ms = int(pd.Timestamp(when).timestamp() * 1000)
                    sent = ms if sent is None else min(sent, ms)
                seen |= what == "seen"
        if sent is not None and seen:
            if state.exists:
                state.remove()
            yield answer("confirmed", sent)
        elif sent is not None:
            state.update((sent,))
            state.setTimeoutTimestamp(max(sent + wait_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    schema = f"`{key}` {name.dataType.simpleString()}, state string, at timestamp"
    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, schema, "sent long", "append", GroupStateTimeout.EventTimeTimeout)
